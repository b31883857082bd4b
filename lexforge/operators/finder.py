"""All references of a paragraph with what is written behind them, and numbers of two courts that need context.

A paragraph is cut once at everything that may begin a reference: labels, and bare volume-part-page triples, which count
only as links of a chain. Each piece then starts with its label and holds what follows up to the next one, so tails are
read from the piece, courts from the end of the piece before, and places are running sums of the pieces' lengths.
:func:`find` does all of this within the text's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import dates, keys
from lexforge.operators import places, references, spans

_B, _E, _C = "\x01", "\x02", "\x03"
_PART = "(?:Ia|Ib|III|II|IV|I|V)"
_STRONG = rf"(?<![\w.])(?:(?:BGE|ATF|DTF) \d{{1,3}} {_PART} \d{{1,4}}|\d[A-Z]{{1,2}}[ _.]\d{{1,5}}/\d{{4}}|[A-Z]{{1,2}}-\d{{1,5}}/\d{{4}})(?!\d)"
_BARE = rf"(?<![\w./])\d{{1,3}} {_PART} \d{{1,4}}(?![\d/]|\.\d)"
# Marks of considerations and of pages, words between numbers, words before a date.
MARKS = r"E\.|Erw\.|Erwägung|Erwaegung|considérant|considerando|consid\.?|cons\.|c\."
PAGES = r"SS?\.|pp?\.|pagg?\."
BETWEEN = "bis|und|u\\.|sowie|à|et|e|a|and|to"
BEFORE_DATE = "vom|du|del|de|of"
#: A reference has so many tails at most.
MOST_TAILS = 4
#: So much of the text before a label is read for a court's name.
COURT_REACH = 120

_NUMBER = r"\d+(?:\.\d+)*[a-z]{0,2}(?:/[a-z]{1,2})?"
_JOINT = rf"(?: *[-,] *| +(?:{BETWEEN}) +)"
_NEXT_NUMBER = rf"{_JOINT}\d{{1,2}}(?:\.\d+)*[a-z]{{0,2}}(?:/[a-z]{{1,2}})?(?![\dA-Z_/]|\.\d| *{_PART} +\d)"
_PIN_TAIL = rf"(?:{MARKS}) *{_NUMBER}(?![\d.]\d)(?:{_NEXT_NUMBER})*"
_PAGE_TAIL = rf"(?:{PAGES}) *\d{{1,4}}(?: *(?-i:ff?\.|ss?\.))?(?!\d)"
_DATE_TAIL = rf"(?:(?:{BEFORE_DATE}) +|dell['’] *)(?:\d{{1,2}}(?:\.|er|°|º)? *\p{{L}}+ +\d{{4}}|\d{{1,2}}\. ?\d{{1,2}}\. ?\d{{4}})(?!\d)"
#: Each tail begins where the one before it ended, the first one right behind the label.
_TAIL = rf"(?iu)\G,? *(?:{_PIN_TAIL}|{_PAGE_TAIL}|{_DATE_TAIL})"
_LINK = r"(?iu)^(?: *[;,] *| +(?:und|et|e|sowie|and|bzw\.|resp\.) +)(?:(?:vgl\.|cf\.|siehe|voir|v\.) +)?$"


def tails(label: Column, rest: Column, read: str = f"^(?:{_STRONG})") -> Column:
    """The tails behind a label, as written: at most four, in any order; none from the first one that would change the label.

    *read* finds the label in a text that starts with it.
    """
    found = F.slice(F.regexp_extract_all(rest, F.lit(_TAIL), F.lit(0)), 1, MOST_TAILS)
    state = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def take(a: Column, tail: Column) -> Column:
        longer = F.concat(a["text"], tail)
        same = F.regexp_extract(F.concat(label, longer), read, 0) == label
        return F.when(a["open"] & same, F.struct(longer.alias("text"), F.lit(True).alias("open"))).otherwise(F.struct(a["text"].alias("text"), F.lit(False).alias("open")))

    return F.aggregate(found, state, take, lambda a: a["text"])


def cited_numbers(tail: Column) -> Column:
    """Numbers of the first list behind a mark, in lower case and order; a range by its two ends."""
    listed = F.regexp_extract(tail, rf"(?iu)(?:^|[ ,;(])(?:{MARKS}) *({_NUMBER}(?:{_NEXT_NUMBER})*)", 1)
    return F.array_distinct(F.transform(F.filter(F.split(listed, rf"(?iu){_JOINT}"), lambda x: x != ""), F.lower))


def cited_pages(tail: Column) -> Column:
    return F.transform(F.regexp_extract_all(tail, F.lit(rf"(?u)(?:^|[ ,])(?:{PAGES}) *(\d{{1,4}})"), F.lit(1)), lambda p: p.cast("int"))


def _marked(text: Column, pattern: str) -> Column:
    """A text cut before every match of *pattern*, which a mark ends. Marks are control characters that the text is freed of first, one space for each."""
    bare = F.translate(text, _B + _E + _C, "   ")
    return F.split(F.regexp_replace(bare, pattern, f"{_B}$0{_E}"), _B)


def _pieces(paragraphs: DataFrame, pattern: str) -> DataFrame:
    """paragraph, nth, piece, start: texts cut before every match of *pattern*, with places in the text without marks."""
    cutted = paragraphs.select("paragraph", F.posexplode(_marked(F.col("text"), pattern)).alias("nth", "piece"))
    before = Window.partitionBy("paragraph").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.replace(F.col("piece"), F.lit(_E), F.lit("")))
    return cutted.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("int"))


def find(paragraphs: DataFrame) -> DataFrame:
    """paragraph, start, end (raw places), written, label, key, courts, pinpoints, pages, written_date, invalid_date of every reference.

    *paragraphs* is (paragraph, text). *written* is the normalised text of the reference with its tails. Links of a chain
    ("BGE 140 III 115 E. 2; 141 III 569") take the collection's name. A null or empty text has no references; ids that
    repeat give the references of a text each only if the texts differ in id.
    """
    # Texts are dealt out once, so that few large files are work for all. From there on a text's pieces stay side by side
    # until those that count are known: nothing is sorted.
    texts = places.with_places(paragraphs.select("paragraph", "text").repartition("paragraph"))
    texts = keys.computed(texts, _marked(keys.normalise(F.col("plain.text")), f"{_STRONG}|{_BARE}").alias("pieces"))
    label, rest = lambda p: F.substring_index(p, _E, 1), lambda p: F.regexp_extract(p, f"(?s){_E}(.*)$", 1)
    parts = F.transform("pieces", lambda p, i: F.struct(F.when(i > 0, label(p)).alias("label"), F.when(i > 0, rest(p)).otherwise(p).alias("rest")))
    full = lambda x: F.coalesce(x["label"].rlike("^[A-Z]|^\\d[A-Z]"), F.lit(False))
    # A bare triple cannot be taken for another label, so its tails are read as those of the collection.
    as_read = lambda x: F.when(full(x), x["label"]).otherwise(F.concat(F.lit("BGE "), x["label"]))
    tailed = F.transform(parts, lambda x: F.struct(x["label"], x["rest"], full(x).alias("full"), F.coalesce(tails(as_read(x), x["rest"]), F.lit("")).alias("tail")))
    left = lambda x: F.substr(x["rest"], F.length(x["tail"]) + 1, F.length(x["rest"]))
    texts = keys.computed(texts, F.transform(tailed, lambda x: F.struct(x["label"], x["full"], x["tail"], left(x).alias("left"))).alias("parts"))
    # One letter a piece: C a label of the collection, F another one, L a bare triple behind a link. A chain is a C and its Ls.
    gap = lambda i: F.get("parts", i - 1)["left"]
    kind = F.transform("parts", lambda x, i: F.when(x["full"], F.when(x["label"].rlike("^(?:BGE|ATF|DTF) "), "C").otherwise("F")).when(gap(i).rlike(_LINK), "L").otherwise("x"))
    kept = F.split(F.regexp_replace(F.array_join(kind, ""), "(?:\\G(?!^)|(?<=C))L", "K"), "")
    size = F.transform("pieces", lambda p: F.length(F.replace(p, F.lit(_E), F.lit(""))))
    width = F.transform("parts", lambda x: F.coalesce(F.length(x["label"]) + F.length(x["tail"]), F.lit(0)))
    texts = texts.select("paragraph", "parts", kept.alias("kept"), places.laid(F.col("plain"), size, width).alias("laid"))
    each = F.transform("parts", lambda x, i: F.struct(F.get("kept", i).alias("kept"), F.get("laid", i)["start"].alias("start"), F.get("laid", i)["end"].alias("end"), x["label"], x["full"], x["tail"], x["left"], gap(i).alias("gap")))
    rows = texts.select("paragraph", F.explode(F.filter(each, lambda x: x["kept"].isin("C", "F", "K"))).alias("x")).select("paragraph", "x.*")
    part = lambda i: F.regexp_extract("label", rf"(\d+) ({_PART}) (\d+)$", i)
    rows = keys.computed(rows, part(1).alias("v"), part(2).alias("p"), part(3).alias("n"), cited_numbers(F.col("tail")).alias("pinpoints"), cited_pages(F.col("tail")).alias("pages"), dates.parts(F.col("tail")).alias("at"))
    key = F.when(F.col("v") != "", keys.collection_key(F.col("v"), F.col("p"), F.col("n"))).otherwise(keys.docket_key(F.col("label")))
    # A court counts if the clause before the label names it.
    clause = F.regexp_extract(F.right(F.coalesce("gap", F.lit("")), F.lit(COURT_REACH)), r"(?s)([^;.]*)$", 1)
    named = F.filter(F.array(*[F.when(F.lower(clause).rlike(words), code) for code, words in references.COURTS]), lambda c: c.isNotNull())
    # The page after a comma, where no page is named: not a year, not the next volume, not far behind the first page.
    comma = F.regexp_extract("left", rf"^, ?(\d{{1,4}})(?![\d/]|\.\d| *{_PART}\b)", 1)
    first, page = F.col("n").try_cast("int"), comma.try_cast("int")
    pages = F.when((F.size("pages") == 0) & (page > first) & (page <= first + references.PAGE_REACH), F.array(page)).otherwise(F.col("pages"))
    return rows.select("paragraph", "start", "end", F.concat("label", "tail").alias("written"), F.when(F.col("full"), F.col("label")).otherwise(F.concat(F.lit("BGE "), F.col("label"))).alias("label"), key.alias("key"), named.alias("courts"), "pinpoints", pages.alias("pages"), dates.iso(F.col("at")).alias("written_date"), dates.impossible(F.col("at")).alias("invalid_date"))


# Forms of Ticino file numbers, and the words before one that make it a reference.
TICINO = r"(?<![\w./])\d{1,2}\.(?:19|20)\d{2}\.\d{1,6}(?!\w|[.,]\d)"
TICINO_WORDS = "sentenza|decisione|giudizio|Tribunale|Pretura|Camera|Corte|TRAM|CDP|CRP|incarto|inc\\."
TICINO_REACH = 60
# The courts that list application numbers, names of the human-rights court, the form of the numbers.
ECHR_COURTS = ("ecthr_chamber", "ecthr_grand_chamber", "hudoc_ch")
ECHR_NAMES = (
    "EGMR|EKMR|EuGMR|CourEDH|Cour EDH|CEDH|Corte ?EDU|CtEDU|ECtHR|ECHR|Gerichtshof(?:es|s)? für Menschenrechte|Cour européenne des droits de l['’]homme"
    "|Corte europea dei diritti dell['’]uomo|European Court of Human Rights"
)
ECHR = r"(?<![\d/.])\d{1,6}/\d{2}(?![\d/])"
ECHR_REACH = 160


def near(paragraphs: DataFrame, numbers: str, words: str, breaks: str, reach: int) -> DataFrame:
    """paragraph, start, end, number, named: numbers, and whether one of the words ends at most *reach* characters before, no break between.

    Numbers, words and breaks are one stream of places for each paragraph; a number looks back at the last word and the
    last break only.
    """
    texts = paragraphs.select("paragraph", keys.normalise(F.coalesce("text", F.lit(""))).alias("text"))
    rows = _pieces(texts, f"(?:{numbers})|(?iu:{words})|(?:{breaks})")
    rows = keys.computed(rows, F.when(F.col("nth") > 0, F.substring_index("piece", _E, 1)).alias("token")).where("token IS NOT NULL")
    rows = rows.withColumn("end", (F.col("start") + F.length("token")).cast("int"))
    kind = F.when(F.col("token").rlike(f"^(?:{numbers})$"), "number").when(F.col("token").rlike(f"^(?iu:{words})$"), "word").otherwise("break")
    rows = keys.computed(rows, kind.alias("kind"))
    back = Window.partitionBy("paragraph").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("end"))).over(back), F.lit(-1))
    rows = rows.withColumn("word_end", last("word")).withColumn("break_end", last("break")).where("kind = 'number'")
    named = (F.col("word_end") > F.col("break_end")) & (F.col("start") - F.col("word_end") <= reach)
    return rows.select("paragraph", "start", "end", F.col("token").alias("number"), named.alias("named"))


def ticino(paragraphs: DataFrame) -> DataFrame:
    """Ticino file numbers and whether a court or decision is named close before them; a full stop breaks unless a digit follows."""
    return near(paragraphs, TICINO, TICINO_WORDS, r"[;\n]|\.(?!\d)", TICINO_REACH)


def applications(paragraphs: DataFrame) -> DataFrame:
    """Application numbers in the clause that names the human-rights court."""
    names = f"(?<![A-Za-z])(?:{ECHR_NAMES})(?![A-Za-z])"
    return near(paragraphs, ECHR, names, ";", ECHR_REACH).where("named").drop("named")


def ticino_status(numbers: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbers with status and note: found where a Ticino court lists them, unchecked where named only, else left out."""
    listed = rows.where(F.col("court").startswith("ti_")).groupBy(F.col("key").alias("number")).agg(F.count("*").alias("n_listed"))
    met = numbers.join(listed, "number", "left").where("named OR n_listed IS NOT NULL")
    found = F.col("n_listed").isNotNull()
    return met.select("paragraph", "start", "end", F.col("number").alias("label"), F.when(found, "found").otherwise("unchecked").alias("status"), F.when(~found, "unknown_shape").alias("note"))


def application_status(numbers: DataFrame, rows: DataFrame) -> DataFrame:
    """Numbers with status and note: found under their own number or as the first of joined ones at the human-rights court.

    A number that only other courts list is theirs and is left out; one that nobody lists is unchecked.
    """
    ours = F.col("court").isin(*ECHR_COURTS)
    own = rows.groupBy(F.col("key").alias("number")).agg(F.max(ours).alias("ours"))
    joined = rows.where(ours & F.col("key").contains("_")).select(F.substring_index("key", "_", 1).alias("number")).distinct().withColumn("joined", F.lit(True))
    met = numbers.join(own, "number", "left").join(joined, "number", "left").where("ours IS NULL OR ours")
    found = F.col("ours").isNotNull() | F.col("joined").isNotNull()
    return met.select("paragraph", "start", "end", F.col("number").alias("label"), F.when(found, "found").otherwise("unchecked").alias("status"), F.when(~found, "echr_not_listed").alias("note"))


def document_findings(paragraphs: DataFrame, checked: DataFrame, rows: DataFrame) -> DataFrame:
    """One list: references (paragraph, start, end, label, status, note) and both kinds of numbers outside of them."""
    others = [application_status(applications(paragraphs), rows), ticino_status(ticino(paragraphs), rows)]
    taken = checked.select("paragraph", "start", "end")
    for more in others:
        outside = spans.free(more, taken, "paragraph")
        checked = checked.unionByName(outside)
        taken = taken.unionByName(outside.select("paragraph", "start", "end"))
    return checked


def occurrence(findings: DataFrame, document: str = "document") -> DataFrame:
    """Findings (document, paragraph, start, label) with nth (from 0) and total of their label in the document."""
    label = Window.partitionBy(document, "label")
    nth = F.row_number().over(label.orderBy("paragraph", "start")) - 1
    return findings.withColumn("nth", nth.cast("long")).withColumn("total", F.count("*").over(label))


def context(text: Column, start: Column, end: Column, most: int = 48) -> Column:
    """struct(before, after): so many characters on either side of a span."""
    low = F.greatest(start - most, F.lit(0))
    return F.struct(F.substr(text, low + 1, start - low).alias("before"), F.substr(text, end + 1, F.lit(most)).alias("after"))


def snippet(text: Column, start: Column, end: Column, most: int = 60) -> Column:
    """A span between what stands around it, cut at word boundaries, with an ellipsis where something is left out."""
    low = F.greatest(start - most, F.lit(0))
    before, after = F.substr(text, low + 1, start - low), F.substr(text, end + 1, F.lit(most))
    cut_before = F.when(low > 0, F.concat(F.lit("…"), F.regexp_replace(before, r"^\S*\s", ""))).otherwise(before)
    cut_after = F.when(end + most < F.length(text), F.concat(F.regexp_replace(after, r"\s\S*$", ""), F.lit("…"))).otherwise(after)
    return F.concat(cut_before, F.substr(text, start + 1, end - start), cut_after)
