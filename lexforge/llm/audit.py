"""Operator 12: what each filter of a chain removes, for every order of the chain.

The audit replays the chain: every document, reduced to the bits of the filters that it fails, meets the 120 orders
(broadcast, one row each), the first step at which it fails is computed, its five steps are exploded and counted under
conditions. Spark sums in the tasks first, so that what is shuffled are 600 rows for each part and task, whatever the
number of documents. The filter that looks at other documents (exact copies) is settled before: the smallest id of each
text is found by its digest, summed in the tasks, and the few digests with very many copies are broadcast.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm.common import hot_join
from lexforge.session import Scratch, table

#: The filters, by the bit that says that a document fails.
FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: White space between words.
GAPS = r"[ \t\n\x0B\f\r]+"
LEAST_WORDS = 200


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and the bits of the filters A to D that it fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, GAPS), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("body"), words.alias("words"))
    capitals = F.length("body") - F.length(F.regexp_replace("body", "[A-Z]+", ""))
    tests = {
        "A": F.size("words") < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"),
        "C": 100 * capitals > 3 * F.length("body"),
        "D": F.col("body").rlike("[#$%&*|]"),
    }
    bits = sum((F.when(test, FILTERS[name]).otherwise(0) for name, test in tests.items()), F.lit(0))
    return rows.select("doc_id", "part", F.sha2("body", 256).alias("digest"), bits.alias("bits"))


def marked(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, bits (all five filters), good and toxic of every document."""
    rows = scratch.cut(failures(docs), "failures")
    firsts = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    copy = F.when(F.col("doc_id") > F.col("first"), FILTERS["E"]).otherwise(0)
    bits = hot_join(rows, firsts, "digest", rows.count()).select("doc_id", "part", (F.col("bits") + copy).alias("bits"))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "bad"))))
    no = F.lit(False)
    known = bits.where("doc_id IS NOT NULL").join(said, "doc_id", "left").select("part", "bits", F.coalesce("good", no).alias("good"), F.coalesce("bad", no).alias("bad"))
    return known.unionByName(bits.where("doc_id IS NULL").select("part", "bits", no.alias("good"), no.alias("bad")))


def replay(flags: DataFrame) -> DataFrame:
    """The audit's rows of flags (part, bits, good, bad), one for each part, order and step."""
    orders = flags.sparkSession.createDataFrame([(k, [FILTERS[f] for f in order]) for k, order in enumerate(ORDERS)], "nr int, chain array<int>")
    met = flags.crossJoin(F.broadcast(orders))  # 120 rows
    failed = [F.when(F.col("bits").bitwiseAND(F.col("chain")[k]) != 0, k + 1) for k in range(len(FILTERS))]
    met = met.withColumn("first", F.coalesce(*failed, F.lit(len(FILTERS) + 1)))
    steps = met.select("part", "bits", "good", "bad", "nr", "first", F.posexplode("chain").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    removed = F.col("first") == F.col("step")
    counts = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": (F.col("first") < F.col("step")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0),
        "unique_fails": F.col("bits") == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("bad"),
    }
    sums = steps.groupBy("part", "nr", "step", "bit").agg(*(F.sum(c.cast("long")).alias(name) for name, c in counts.items()))
    # 120 rows for each part and filter, whatever the number of documents.
    sums = sums.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit")))
    names = F.array(*(F.lit(order) for order in ORDERS))
    return sums.select("part", F.element_at(names, F.col("nr") + 1).alias("filter_order"), "step", *counts, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is an empty one, a null language the part of the empty string. Rows that share an id and a text are no
    copies of each other, since neither id is smaller; a null id is neither smaller nor larger than any other and has no
    label. Of several labels of an id one that says so is enough. Texts are read whole, however long; repeated rows count
    as documents; an empty table has no parts and so no rows. Other columns are ignored whatever their names.
    """
    return replay(marked(docs, labels, Scratch(docs.sparkSession)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE_SQL = {
    "op12_filter_audit": r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents
), cut AS (
    SELECT *, list_filter(string_split_regex(body, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words FROM texts
), flagged AS (
    SELECT doc_id, part,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails
    FROM cut
), said AS (
    SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id
), counted AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE bad) AS n_bad
    FROM flagged LEFT JOIN said USING (doc_id) GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT part, filter_order, s.step, substr(filter_order, s.step, 1) AS f, fails, n, n_good, n_bad,
        coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: contains(fails, substr(filter_order, k, 1)))), 6) AS first
    FROM counted, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), sums AS (
    SELECT part, filter_order, step, f,
        sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN first < step AND contains(fails, f) THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN first = step THEN n_good ELSE 0 END) AS good_lost,
        sum(CASE WHEN first = step THEN n_bad ELSE 0 END) AS toxic_lost
    FROM steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM sums
""",
}
