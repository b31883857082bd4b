"""References in prose: finding, parsing, and checking against the list of decisions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import dates, keys
from lexforge.operators import citelist

_COLLECTION = r"(?:BGE|ATF|DTF) \d{1,3} (?:III|II|IV|Ia|Ib|I|V) \d{1,4}"
_FEDERAL = r"\d[A-Z]{1,2}[ _.]\d{1,5}/\d{4}"
_ADMINISTRATIVE = r"[A-Z]{1,2}-\d{1,5}/\d{4}"
LABEL = f"((?:{_COLLECTION})|(?:{_FEDERAL})|(?:{_ADMINISTRATIVE}))"
# Courts by a word of their names.
COURTS = (("bger", "bundesgericht|tribunal fédéral|tribunale federale"), ("bvger", "bundesverwaltungsgericht|tribunal administratif fédéral"), ("bstger", "bundesstrafgericht|tribunal pénal fédéral"))
# The cantons with their names in German, French, Italian and English.
CANTONS = {
    "ZH": "Zürich Zurich Zurigo", "BE": "Bern Berne Berna", "LU": "Luzern Lucerne Lucerna", "UR": "Uri", "SZ": "Schwyz Svitto", "OW": "Obwalden Obwald Obvaldo",
    "NW": "Nidwalden Nidwald Nidvaldo", "GL": "Glarus Glaris Glarona", "ZG": "Zug Zoug Zugo", "FR": "Freiburg Fribourg Friburgo", "SO": "Solothurn Soleure Soletta",
    "BS": "Basel-Stadt Bâle-Ville", "BL": "Basel-Landschaft Bâle-Campagne", "SH": "Schaffhausen Schaffhouse Sciaffusa", "AR": "Ausserrhoden", "AI": "Innerrhoden",
    "SG": "St.Gallen Saint-Gall", "GR": "Graubünden Grisons Grigioni", "AG": "Aargau Argovie Argovia", "TG": "Thurgau Thurgovie Turgovia", "TI": "Tessin Ticino",
    "VD": "Waadt Vaud", "VS": "Wallis Valais Vallese", "NE": "Neuenburg Neuchâtel", "GE": "Genf Genève Ginevra Geneva", "JU": "Jura Giura",
}
# Names of cantonal courts, and the forms of their file numbers.
CANTONAL_COURTS = "Obergericht|Kantonsgericht|Verwaltungsgericht|Appellationsgericht|Handelsgericht|Sozialversicherungsgericht|OGer|KGer|VGer|HGer|Tribunal cantonal|Cour de justice|Cour d'appel|Tribunale d'appello|Tribunale cantonale"
CANTONAL_DOCKETS = (
    r"[A-Z]{2}\.\d{4}\.\d{5}", r"[A-Z]{2}\d{6}(?:-[A-Z])?", r"\d{2,3}\.\d{4}\.\d{1,4}", r"\d{3} \d{2,4} \d{1,4}",
    r"[A-Z]{1,4}/\d{1,5}/\d{4}", r"[A-Z]{1,4} \d{4}/\d{1,4}", r"[A-Z]{1,4} \d{4} \d{1,4}", r"[A-Z]{2,4}\d{4}\.\d{1,4}",
)
_FIRST = "".join(sorted({name[0] for name in CANTONAL_COURTS.split("|")}))
#: Characters between a court's name and its file number, at most.
COURT_REACH = 40
#: What a reference names of the list: a key, and courts or a canton.
SCOPE = ["key", "courts", "canton"]
#: Pages after a comma count as pages of the decision up to so many behind its first.
PAGE_REACH = 200


def pinpoints(text: Column) -> Column:
    """All cited numbers: after the mark of a consideration, as a list or range ("E. 2.3 und 2.4", "consid. 3-5")."""
    more = r"((?<![A-Za-z])(?:E|Erw|consid|cons)\.?\s*\d+(?:\.\d+)*[a-z]{0,2}(?:/[a-z]{1,2})*(?:\s*(?:,|und|et|e|-|bis|f{1,2}\.)\s*\d+(?:\.\d+)*[a-z]{0,2}(?:/[a-z]{1,2})*(?![\d/_]))*)"
    span = F.regexp_extract(text, more, 1)
    return F.array_distinct(F.regexp_extract_all(span, F.lit(r"\d+(?:\.\d+)*(?:[a-z]{1,2})?(?:/[a-z]{1,2})*"), F.lit(0)))


def find_labels(paragraphs: DataFrame) -> DataFrame:
    """paragraph, nth, label of every label in a paragraph's text."""
    found = F.regexp_extract_all(keys.normalise(F.col("text")), F.lit(LABEL), F.lit(1))
    return paragraphs.select("paragraph", F.posexplode(found).alias("nth", "label")).select("paragraph", F.col("nth").cast("long").alias("nth"), "label")


def continued(text: Column) -> Column:
    """Collection labels of a chain in which the collection's name is written once ("BGE 140 III 115; 141 II 3")."""
    chain = F.regexp_extract_all(text, F.lit(r"((?:BGE|ATF|DTF) \d{1,3} (?:III|II|IV|Ia|Ib|I|V) \d{1,4}(?:(?:; |, | und | et | e )\d{1,3} (?:III|II|IV|Ia|Ib|I|V) \d{1,4})*)"), F.lit(1))
    return F.flatten(F.transform(chain, lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,3} (?:III|II|IV|Ia|Ib|I|V) \d{1,4})"), F.lit(1)), lambda x: F.concat(F.lit("BGE "), x))))


def cantonal_label(text: Column) -> Column:
    """The first file number in one of the cantonal forms that follows a cantonal court's name closely; empty if none does."""
    # Only letters that begin a court's name are tried against the names.
    return F.regexp_extract(text, rf"(?=[{_FIRST}])(?:{CANTONAL_COURTS})\w*[^\n]{{0,{COURT_REACH}}}?(?<![\w.])({'|'.join(CANTONAL_DOCKETS)})(?![\w/])", 1)


def named_canton(text: Column) -> Column:
    """The canton that a text names first, by name or, behind a court or the word canton, by its code; null if none is."""
    by_name = {name.lower(): code for code, names in CANTONS.items() for name in names.split()}
    known = F.create_map(*[F.lit(x) for pair in sorted(by_name.items()) for x in pair])
    # Names by their first letter, so that a word is tried against few; no name goes on where another one ends.
    ends = {a: "|".join(sorted((re.escape(n[1:]) for n in by_name if n[0] == a), key=lambda n: (-len(n), n))) for a in sorted({n[0] for n in by_name})}
    names = "|".join(f"{a}(?:{rest})" for a, rest in ends.items())
    plain = F.replace(text, F.lit("St. Gallen"), F.lit("St.Gallen"))
    name = F.regexp_extract(plain, rf"(?iu)(?<![\p{{L}}-])({names})(?![\p{{L}}-])", 1)
    # Most texts hold no name anywhere, which is told faster than where a name may begin.
    some = F.exists(F.array(F.lower(plain)), lambda t: reduce(or_, [t.contains(n) for n in sorted(by_name)]))
    name = F.when(some, name)
    codes = "|".join(CANTONS)
    # Few texts hold a code at all, so that is asked first.
    code = F.when(plain.rlike(rf" (?:{codes})(?!\w)"), F.regexp_extract(plain, rf"(?:(?:{CANTONAL_COURTS})|[Kk]antons?|[Cc]anton(?:e)?(?: d[eui])?) ({codes})(?!\w)", 1))
    return F.coalesce(F.try_element_at(known, F.lower(name)), F.nullif(code, F.lit("")))


def page_tail(text: Column) -> Column:
    """The page behind a collection label and a comma ("BGE 140 III 115, 120"), if it lies at most PAGE_REACH behind the first."""
    part = lambda i: F.regexp_extract(text, rf"(?:BGE|ATF|DTF) \d{{1,3}} (?:III|II|IV|Ia|Ib|I|V) (\d{{1,4}}),\s*(?:S\.\s*|p\.\s*)?(\d{{1,4}})(?![\d./])", i)
    first, page = F.try_to_number(part(1), F.lit("9999")).cast("int"), F.try_to_number(part(2), F.lit("9999")).cast("int")
    return F.when((page > first) & (page <= first + PAGE_REACH), page)


def page_issues(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """ref_id, key, page, last of references (ref_id, key, page) whose page lies behind the decision's last one."""
    return refs.where("page IS NOT NULL").join(ranges.select("key", "last"), "key").where("page > last").select("ref_id", "key", "page", "last")


def page_status(refs: DataFrame, ranges: DataFrame) -> DataFrame:
    """ref_id, key, status, outside, first, last of references (ref_id, key, pages) to listed decisions of the collection.

    status is page if a page lies before the decision's first or behind its last, page_inside if none does, open if none
    does and the last one is not known (the last decision of a part); without pages a reference is left out.
    """
    met = refs.where(F.size("pages") > 0).join(ranges.select("key", "first", "last"), "key")
    outside = F.filter("pages", lambda p: (p < F.col("first")) | F.coalesce(p > F.col("last"), F.lit(False)))
    status = F.when(F.size("outside") > 0, "page").when(F.col("last").isNotNull(), "page_inside").otherwise("open")
    return met.withColumn("outside", outside).select("ref_id", "key", status.alias("status"), "outside", "first", "last")


#: What is read of a reference.
PARSED = ("label", "key", "courts", "written_date", "invalid_date", "pinpoint", "pinpoints", "canton")


def parsed(references: DataFrame, *columns: str) -> DataFrame:
    """ref_id with label, key, courts and canton (named before the label), written_date, invalid_date, pinpoints and the first of them.

    The earliest label counts, be it of the collection, a federal court or, behind its court's name, a cantonal one. With
    *columns* only these are read: columns computed behind a generator are not left out by the optimizer.
    """
    asks = lambda *names: not columns or not {*names}.isdisjoint(columns)
    labelled, scoped, dated, pinned = asks("label", "key", "courts", "canton"), asks("courts", "canton"), asks("written_date", "invalid_date"), asks("pinpoint", "pinpoints")
    rows = references.select("ref_id", keys.normalise(F.col("prose")).alias("plain"))
    first = {"federal": (labelled, F.regexp_extract("plain", LABEL, 1)), "cantonal": (labelled, cantonal_label(F.col("plain"))), "date": (dated, dates.written(F.col("plain"))), "pinpoints": (pinned, pinpoints(F.col("plain")))}
    rows = keys.computed(rows, *[c.alias(name) for name, (asked, c) in first.items() if asked])
    earlier = (F.col("federal") != "") & ((F.col("cantonal") == "") | (F.instr("plain", F.col("federal")) <= F.instr("plain", F.col("cantonal"))))
    label = F.nullif(F.when(earlier, F.col("federal")).otherwise(F.col("cantonal")), F.lit(""))
    second = {"label": (labelled, label), "at": (dated, dates.stated_parts(F.col("date")))}
    if labelled or dated:
        rows = keys.computed(rows, *[c.alias(name) for name, (asked, c) in second.items() if asked])
    if scoped:
        rows = keys.computed(rows, F.coalesce(F.split_part("plain", "label", F.lit(1)), "plain").alias("before"))
        rows = keys.computed(rows, F.lower("before").alias("low"))
    named = F.filter(F.array(*[F.when(reduce(or_, [F.col("low").contains(w) for w in words.split("|")]), code) for code, words in COURTS]), lambda c: c.isNotNull())
    part = lambda i: F.regexp_extract("label", r"^(?:BGE|ATF|DTF) (\d+) (\w+) (\d+)$", i)
    key = F.when(F.col("label").rlike(r"^(?:BGE|ATF|DTF) \d+ \w+ \d+$"), keys.collection_key(part(1), part(2), part(3))).when(F.col("label").isNotNull(), keys.docket_key(F.col("label")))
    third = {"key": (asks("key"), key), "courts": (asks("courts"), named), "canton": (asks("canton"), named_canton(F.col("before"))), "written_date": (asks("written_date"), dates.iso(F.col("at"))), "invalid_date": (asks("invalid_date"), dates.impossible(F.col("at"))), "pinpoint": (asks("pinpoint"), F.get("pinpoints", F.lit(0)))}
    third = [c.alias(name) for name, (asked, c) in third.items() if asked]
    rows = keys.computed(rows, *third) if third else rows
    return rows.select("ref_id", *[c for c in PARSED if not columns or c in columns])


def all_findings(checked: DataFrame, loose: DataFrame) -> DataFrame:
    """source (parsed or loose), at, label, status and kind: checked references and loose labels as one list.

    *checked* is (ref_id, label, status), *loose* as :func:`loose_status` gives it.
    """
    first = checked.select(F.lit("parsed").alias("source"), F.col("ref_id").cast("long").alias("at"), "label", "status", F.lit(None).cast("string").alias("kind"))
    return first.unionByName(loose.select(F.lit("loose").alias("source"), F.col("paragraph").cast("long").alias("at"), "label", "status", "kind"))


def _places(rows: DataFrame, *about: Column) -> DataFrame:
    """One row for each key and court of the list, with what *about* tells of its lines."""
    return rows.groupBy("key", F.col("court").alias("row_court"), F.col("canton").alias("row_canton")).agg(*about)


def _scopes(refs: DataFrame, places: DataFrame) -> DataFrame:
    """What references name (key, courts, canton), each once, beside the places of their key, and whether each is in scope.

    References meet courts here, not lines: a key of many lines costs no more than one of few.
    """
    scope = keys.in_scope(F.col("courts"), F.col("canton"), F.col("row_court"), F.col("row_canton"))
    asked = refs.select(*SCOPE).where("key IS NOT NULL").distinct()
    return asked.join(places, "key").withColumn("scoped", F.coalesce(scope, F.lit(False)))


def _full(date: Column) -> Column:
    return keys.full_date(date) & ~date.endswith("-01-01")


def court_issues(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """ref_id, key, listed (courts in order) and n of references whose label is listed, but at no court they name."""
    met = _scopes(refs, _places(rows, F.count("*").alias("n"))).groupBy(*SCOPE).agg(F.bool_or("scoped").alias("inside"), F.array_sort(F.collect_set("row_court")).alias("listed"), F.sum("n").alias("n"))
    return citelist.joined(refs.select("ref_id", *SCOPE), met.where("NOT inside"), SCOPE, "inner").select("ref_id", "key", "listed", "n")


def date_issues(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """ref_id, key, written_date and listed (dates in order) where every line in scope has a full date and none is the written one."""
    places = _places(rows, F.bool_and(_full(F.col("date"))).alias("full"), F.collect_set("date").alias("dates"))
    met = _scopes(refs, places).where("scoped").groupBy(*SCOPE).agg(F.bool_and("full").alias("full"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("dates")))).alias("listed"))
    found = citelist.joined(refs.select("ref_id", *SCOPE, "written_date").where("written_date IS NOT NULL"), met.where("full"), SCOPE, "inner")
    return found.where(~F.array_contains("listed", F.col("written_date"))).select("ref_id", "key", "written_date", "listed")


def check(refs: DataFrame, rows: DataFrame, *carried: str) -> DataFrame:
    """ref_id, key, status, issues, notes, counts and the *carried* columns of every parsed reference against the list.

    Statuses: missing, differs, found; unchecked where no label was read. Lines are summed up by key and court and asked
    once for each scope, pinpoint and date that references name, so that no reference meets all lines of its key. *refs*
    is read several times.
    """
    numbers = rows.select("key", F.col("court").alias("row_court"), F.col("canton").alias("row_canton"), F.explode("enums").alias("e"))
    numbers = numbers.groupBy("key", "row_court", "row_canton").agg(F.collect_set("e").alias("es"))
    written = F.concat("court", "date")
    places = _places(rows, F.count("*").alias("n"), F.count_if(_full(F.col("date"))).alias("n_full"), F.min(written).alias("low"), F.max(written).alias("high"))
    scoped = _scopes(refs, places.join(numbers, ["key", "row_court", "row_canton"], "left"))
    only = lambda c: F.when(F.col("scoped"), F.col(c))
    scopes = scoped.groupBy(*SCOPE).agg(
        F.sum("n").alias("n_listed"),
        F.coalesce(F.sum(only("n")), F.lit(0)).alias("n_scoped"),
        F.coalesce(F.sum(only("n_full")), F.lit(0)).alias("n_dated"),
        (F.min(only("low")) != F.max(only("high"))).alias("unlike"),
        F.array_distinct(F.flatten(F.collect_list(only("es")))).alias("enums"),
    )
    pins = citelist.joined(refs.select(*SCOPE, "pinpoint").distinct(), scopes, SCOPE).withColumn("n_listed", F.coalesce("n_listed", F.lit(0))).withColumn("n_scoped", F.coalesce("n_scoped", F.lit(0)))
    pins = pins.withColumn("pin_state", F.when(F.col("pinpoint").isNotNull() & (F.col("n_scoped") > 0), citelist.pinpoint_state(F.col("pinpoint"), F.col("enums")))).drop("enums")
    days = rows.select("key", F.col("court").alias("row_court"), F.col("canton").alias("row_canton"), F.col("date").alias("written_date")).distinct()
    same = refs.select(*SCOPE, "written_date").distinct().join(days, ["key", "written_date"])
    same = same.where(keys.in_scope(F.col("courts"), F.col("canton"), F.col("row_court"), F.col("row_canton"))).select(*SCOPE, "written_date").distinct().withColumn("same", F.lit(True))
    g = citelist.joined(citelist.joined(refs.select("ref_id", *SCOPE, "written_date", "invalid_date", "pinpoint", *carried), pins, [*SCOPE, "pinpoint"]), same, [*SCOPE, "written_date"])
    court = (F.col("n_listed") > 0) & (F.col("n_scoped") == 0)
    inside = F.col("n_scoped") > 0
    date = inside & F.col("written_date").isNotNull() & (F.col("n_dated") == F.col("n_scoped")) & F.col("same").isNull()
    issues = [(court, "court"), (inside & F.col("invalid_date").isNotNull(), "date_invalid"), (date, "date"), (inside & F.col("pinpoint").isNotNull() & (F.col("pin_state") == "absent"), "pinpoint")]
    notes = [(inside & (F.col("pin_state") == "no_structure"), "pinpoint_no_structure"), (inside & (F.col("pin_state") == "parent_only"), "pinpoint_parent_only"), (inside & (F.col("n_scoped") > 1) & F.col("unlike"), "several")]
    tagged = lambda pairs: F.filter(F.array(*[F.when(c, name) for c, name in pairs]), lambda x: x.isNotNull())
    g = g.withColumn("issues", tagged(issues)).withColumn("notes", tagged(notes))
    status = F.when(F.col("key").isNull(), "unchecked").when(F.col("n_listed") == 0, "missing").when(F.size("issues") > 0, "differs").otherwise("found")
    return g.select("ref_id", "key", status.alias("status"), "issues", "notes", "n_listed", "n_scoped", *carried)


def status_counts(findings: DataFrame) -> DataFrame:
    """status, n for all four statuses, zeros included."""
    spark = findings.sparkSession
    every = spark.createDataFrame([("differs",), ("found",), ("missing",), ("unchecked",)], "status string")
    counts = findings.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def numbered(findings: DataFrame, document: str = "document") -> DataFrame:
    """Findings with their number in the document, the position of their paragraph (0 to 1) and their nth occurrence.

    *findings* has (document, paragraph, start, label, length of the paragraph); offsets run over the paragraphs.
    """
    order = Window.partitionBy(document).orderBy("paragraph", "start")
    nth = Window.partitionBy(document, "label").orderBy("paragraph", "start")
    return findings.withColumn("number", (F.row_number().over(order) - 1).cast("long")).withColumn("nth", (F.row_number().over(nth) - 1).cast("long"))


# Law journals whose citations look like labels.
JOURNALS = ("SJ", "JdT", "RtiD", "ZBl", "Pra", "JAR", "RDAF", "SZZP")
LOOSE = rf"\b((?:{'|'.join(JOURNALS)}) \d{{4}} (?:I{{1,3}} )?\d{{1,4}}|[A-Z]{{2,4}}[. ]\d{{4}}[./]\d{{1,5}}|[A-Z]{{1,3}}\d? \d{{1,4}}/\d{{4}})\b"


def loose_labels(paragraphs: DataFrame) -> DataFrame:
    """paragraph, nth, label, kind: what looks like a label in a form the list cannot answer, accepted labels left out.

    kind is ``collection`` for a journal's citation, else ``unknown_shape``.
    """
    bare = F.regexp_replace(keys.normalise(F.col("text")), LABEL, " ")
    found = paragraphs.select("paragraph", F.posexplode(F.regexp_extract_all(bare, F.lit(LOOSE), F.lit(1))).alias("nth", "label"))
    return found.select("paragraph", F.col("nth").cast("long").alias("nth"), "label", F.when(F.substring_index("label", " ", 1).isin(*JOURNALS), "collection").otherwise("unknown_shape").alias("kind"))


def loose_status(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Loose labels with their status: found if the list has them after all, else unchecked."""
    listed = rows.select(F.col("key").alias("__key")).distinct()
    met = labels.withColumn("__label", keys.docket_key(F.col("label"))).join(listed, F.col("__label") == F.col("__key"), "left")
    return met.select("paragraph", "nth", "label", "kind", F.when(F.col("__key").isNotNull(), "found").otherwise("unchecked").alias("status"))


def positions(paragraphs: DataFrame) -> DataFrame:
    """document, paragraph, offset, position: characters before each paragraph, and their share of the document."""
    w = Window.partitionBy("document").orderBy("paragraph")
    size = F.length("text").cast("long") + 1
    offset = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return paragraphs.select("document", "paragraph", offset.alias("offset"), F.round(offset / F.sum(size).over(Window.partitionBy("document")), 6).alias("position"))


def applications(paragraphs: DataFrame) -> DataFrame:
    """paragraph, number: application numbers of the human-rights court, where a clause names the court before them."""
    clauses = paragraphs.select("paragraph", F.explode(F.split(keys.normalise(F.col("text")), ";")).alias("clause"))
    named = F.regexp_extract_all("clause", F.lit(r"(?i)(?:EGMR|CourEDH|CEDU|ECtHR)[^;]{0,160}?\b(\d{1,6}/\d{2})\b"), F.lit(1))
    return clauses.select("paragraph", F.explode(named).alias("number"))
