"""Samples, quantiles and recall tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators import identifiers, vocabulary


def stratified(rows: DataFrame, stratum: str, identity: str, most: int, seed: int = 1) -> DataFrame:
    """At most *most* rows of each stratum, those with the smallest digest of seed and id (a sampling operator)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(identity).cast("string")).cast("binary"))
    order = Window.partitionBy(stratum).orderBy(digest, identity)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).drop("__n")




def lengths(per_document: DataFrame, group: str = "lang") -> DataFrame:
    """group, documents, median, p90, p99, none of entry counts (group, n).

    Counts are first reduced to a histogram, so that a group of any size is one short row for each distinct count.
    """
    histogram = per_document.groupBy(group, "n").agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    ranked = histogram.withColumn("upto", F.sum("c").over(w.orderBy("n"))).withColumn("total", F.sum("c").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), F.col("n")))
    half = (F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("n"))) + F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n")))) / 2
    return ranked.groupBy(group).agg(F.max("total").alias("documents"), half.cast("double").alias("median"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.round(F.sum(F.when(F.col("n") == 0, F.col("c")).otherwise(0)) / F.max("total"), 6).alias("none"))


def hit_rates(trials: DataFrame) -> DataFrame:
    """form, mode, n, hits of trials (form, mode, hit), with a row over all modes for each form (mode ``all``)."""
    both = trials.select("form", F.explode(F.array("mode", F.lit("all"))).alias("mode"), "hit")
    return both.groupBy("form", "mode").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def caught(tokens: DataFrame, shown: DataFrame) -> DataFrame:
    """doc, mention, caught: whether every token of a mention overlaps a shown span of its document.

    Tokens and spans meet in cells of 64 characters, so a document's spans are not paired with all its tokens.
    """
    cell = 64
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell))))
    t = cells(tokens.select("doc", "mention", "start", "end"))
    s = cells(shown.select("doc", "start", "end")).select("doc", "cell", F.col("start").alias("s"), F.col("end").alias("e"))
    met = t.join(s, ["doc", "cell"]).where("start < e AND s < end").select("doc", "mention", "start", "end").distinct().withColumn("hit", F.lit(True))
    return tokens.join(met, ["doc", "mention", "start", "end"], "left").groupBy("doc", "mention").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("caught"))


def entity_recall(mentions: DataFrame) -> DataFrame:
    """group, entities, found of mentions (annotator, doc, entity, kind, type, caught): an entity needs all its mentions."""
    per = mentions.groupBy("annotator", "doc", "entity", "kind", "type").agg(F.bool_and("caught").alias("caught"))
    grouped = per.select(F.explode(F.array(F.col("kind"), F.concat_ws(":", "kind", "type"))).alias("group"), "caught")
    return grouped.groupBy("group").agg(F.count("*").alias("entities"), F.count_if("caught").alias("found"))


def percent(hits: Column, total: Column) -> Column:
    """``98.2 % (1,234/1,256)``; n/a where there is nothing to count."""
    shown = F.format_string("%.1f %% (%,d/%,d)", (100 * hits / total).cast("double"), hits.cast("long"), total.cast("long"))
    return F.when(total > 0, shown).otherwise("n/a")


def mask_positions(docs: DataFrame, head: int = 2500, tail: int = 800) -> DataFrame:
    """id, nth, start, end, mask of masked names (id, text) that stand neither in the first *head* nor the last *tail* characters."""
    mask = F.lit(identifiers.PLACEHOLDER)
    both = F.arrays_zip(F.split("text", identifiers.PLACEHOLDER, -1).alias("piece"), F.regexp_extract_all("text", mask, F.lit(0)).alias("mask"))
    cut = docs.select("id", F.length("text").alias("size"), F.posexplode(both).alias("nth", "p"))
    upto = F.sum(F.length("p.piece") + F.coalesce(F.length("p.mask"), F.lit(0))).over(Window.partitionBy("id").orderBy("nth"))
    found = cut.select("id", F.col("nth").cast("long").alias("nth"), (upto - F.length("p.mask")).alias("start"), upto.alias("end"), "p.mask", "size").where("mask IS NOT NULL")
    return found.where((F.col("start") > head) & (F.col("start") < F.col("size") - tail)).drop("size")


def for_trials(docs: DataFrame, least: int = 1500, masks: int = 3, holdout: int = 10) -> DataFrame:
    """Rows (id, text) that trials may use: held out of the vocabulary, long, and anonymised by their own court."""
    masked = F.regexp_count("text", F.lit(identifiers.PLACEHOLDER)) >= masks
    return docs.where((F.length("text") >= least) & masked & vocabulary.held_out(F.col("id"), holdout))


def spliced(text: Column, start: Column, end: Column, insert: Column) -> Column:
    """*text* with *insert* in place of what lies from *start* to *end*."""
    return F.concat(F.substr(text, F.lit(1), start), insert, F.substr(text, end + 1, F.length(text)))


def identifier_cases(rows: DataFrame) -> DataFrame:
    """id, label, phrase: seven made-up identifiers for each whole-numbered id, with check digits that hold."""
    x = F.pmod(F.col("id").cast("long"), F.lit(1_000_000_000))
    number = lambda a, b, m: (x * a + b) % m
    digits = lambda a, b, n: F.lpad(number(a, b, 10**n).cast("string"), n, "0")
    twelve = F.concat(F.lit("756"), digits(104729, 7, 9))
    at = lambda i: F.substr(twelve, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + at(i) * F.when(i % 2 == 0, 3).otherwise(1))
    insured = F.regexp_replace(F.concat(twelve, ((10 - total % 10) % 10).cast("string")), r"^(\d{3})(\d{4})(\d{4})(\d{2})$", "$1.$2.$3.$4")
    account = F.concat(digits(15485863, 11, 9), digits(32452843, 13, 8))
    # C and H count as 12 and 17; the check digits bring the whole number to 1 by 97.
    check = 98 - F.concat(account, F.lit("121700")).cast("decimal(23,0)") % 97
    iban = F.regexp_replace(F.concat(F.lit("CH"), F.lpad(check.cast("int").cast("string"), 2, "0"), account), "(.{4})(?=.)", "$1 ")
    text = lambda a, b, m, low: (number(a, b, m) + low).cast("string")
    cases = {
        "ahv": F.concat(F.lit("AHV-Nr. "), insured),
        "iban": F.concat(F.lit("IBAN "), iban),
        "mobile": F.concat(F.lit("Telefon 079 "), text(31, 1, 900, 100), F.lit(" "), text(37, 2, 90, 10), F.lit(" "), text(41, 3, 90, 10)),
        "address": F.concat(F.lit("wohnhaft in der Seegasse "), text(43, 4, 99, 1), F.lit(", "), text(47, 5, 8000, 1000), F.lit(" Musterdorf")),
        "plate": F.concat(F.lit("Fahrzeug mit dem Kennzeichen ZH "), text(53, 6, 900000, 10000)),
        "parcel": F.concat(F.lit("Parzelle Nr. "), text(59, 8, 9900, 100)),
        "birth_date": F.concat(F.lit("geboren am "), text(61, 9, 28, 1), F.lit(". März 19"), text(67, 10, 60, 40)),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("phrase")) for k, v in cases.items()])
    return rows.select("id", F.explode(pairs).alias("c")).select("id", "c.*")


def identifier_recall(docs: DataFrame, masks: DataFrame) -> DataFrame:
    """label, n, hits, shown: made-up identifiers put behind a mask of each document (id, text), and how many a scan shows.

    *masks* is (id, start, end), one row for each document; a row for each document and identifier is scanned by itself.
    """
    texts = docs.join(masks.select("id", "start", "end"), "id").join(identifier_cases(masks.select("id")), "id")
    key, put = F.concat_ws(":", F.col("id").cast("string"), "label"), F.concat(F.lit(", "), F.col("phrase"), F.lit(","))
    at = F.col("end") + 2
    trials = texts.select(key.alias("trial"), "label", at.alias("from"), (at + F.length("phrase")).alias("to"), spliced(F.col("text"), F.col("end"), F.col("end"), put).alias("text"))
    found = identifiers.identifiers(trials.select(F.col("trial").alias("id"), "text")).select(F.col("id").alias("trial"), "start", F.col("end").alias("stop"))
    hits = trials.drop("text").join(found, "trial", "left").groupBy("trial", "label").agg(F.coalesce(F.bool_or((F.col("start") < F.col("to")) & (F.col("stop") > F.col("from"))), F.lit(False)).alias("hit"))
    counts = hits.groupBy("label").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    return counts.select("label", "n", "hits", percent(F.col("hits"), F.col("n")).alias("shown"))


def forms(names: DataFrame) -> DataFrame:
    """name, form, written: eight ways to write a person (first, last)."""
    f, n = F.col("first"), F.col("last")
    ways = {"surname": n, "full": F.concat_ws(" ", f, n), "possessive": F.concat(n, F.lit("s")), "capitals": F.upper(n), "initial": F.concat(F.substring(f, 1, 1), F.lit(". "), n), "double": F.concat(n, F.lit("-"), n), "mail": F.concat(F.lower(f), F.lit("."), F.lower(n), F.lit("@gmail.com")), "spelt_out": F.replace(F.replace(F.replace(n, F.lit("ä"), F.lit("ae")), F.lit("ö"), F.lit("oe")), F.lit("ü"), F.lit("ue"))}
    return names.select(F.concat_ws(" ", f, n).alias("name"), F.explode(F.array(*[F.struct(F.lit(k).alias("form"), v.alias("written")) for k, v in ways.items()])).alias("w")).select("name", "w.*")
