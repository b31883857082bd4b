"""Operator 3: cross-site boilerplate lines by distinct-site spread, in DataFrame functions only.

For each line hash the sites that show it are counted by HyperLogLog sketches, which are built in every task and
merged by the aggregation. Lines whose estimate lies near the threshold get an exact distinct count. Lines on enough
sites are boilerplate; all but their first occurrence are removed, so that no text is lost from the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import keys
from lexforge.llm.common import unused
from lexforge.session import Scratch, table

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 8
#: Sketch precision, and how many standard errors (at least one site) around the threshold are counted exactly.
LG_K, ERRORS = 12, 4.0


def numbered_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """row (doc_id and a hash of the text), site, pos and the two hashes of every non-blank line, spaces at its ends aside."""
    # Hashed below the generator, once a text; in one select with it the hash would be taken again for each line.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.col(site).cast("string").alias("site"), F.split("text", "\n").alias("cut"))
    lines = rows.select("doc_id", "body", "site", F.posexplode("cut").alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    return lines.select("doc_id", "body", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 and the first place (doc_id, body, pos) of the lines that *min_sites* distinct sites or more show."""
    first = F.min(F.struct("doc_id", "body", "pos")).alias("first")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), first)
    spread = spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = scratch.cut(spread.where(F.col("sites") >= F.lit(min_sites - margin)), "spread")
    sure = F.col("sites") > F.lit(min_sites + margin)
    near = spread.where(~sure).select("h1", "h2")
    # Two steps, so that a hot line is first reduced to its sites in every task.
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("sites"))
    exact = exact.where(F.col("sites") >= min_sites).select("h1", "h2")
    return spread.where(sure).select("h1", "h2", "first").unionByName(spread.where(~sure).join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """All columns of *docs* with the text cleaned, and ``__n_lines`` and ``__n_removed`` (with more underscores before
    them if *docs* has columns of these names, as all columns that are joined have).

    Lines are what newlines separate; blank ones are never removed. Rows without a site count for no site but are
    cleaned. A null text stays null (no lines), an empty one has one blank line; an empty table gives no rows. A line's
    first place, which stays, is the least (doc_id, hash of the text, position); null ids sort first. Repeated rows
    (equal doc_id and text) are one place and treated alike; of unlike texts with one doc_id one is first.
    """
    scratch = Scratch(docs.sparkSession)
    n_lines, n_removed, doc, body, gone_name, cut_name = unused(docs, "__n_lines", "__n_removed", "line_doc", "line_body", "line_gone", "line_cut")
    lines = numbered_lines(docs, site)
    found = scratch.cut(boilerplate(lines, scratch, min_sites), "boilerplate")
    later = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("body") != F.col("first.body")) | (F.col("pos") != F.col("first.pos"))
    gone = lines.join(found, ["h1", "h2"]).where(later).groupBy("doc_id", "body").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("body").alias(body), F.col("gone").alias(gone_name))
    joined = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(body)), "left")
    # The lines are cut once a row; the places that stay are a difference of sets, which takes one step for each line.
    joined = keys.computed(joined, F.split("text", "\n").alias(cut_name))
    places = F.array_except(F.sequence(F.lit(0), F.size(cut_name) - 1), F.col(gone_name))
    kept = F.when(F.col(gone_name).isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col(cut_name), i)), "\n"))
    counts = [F.coalesce(F.when(F.col("text").isNotNull(), F.size(cut_name)), F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.when(F.col(gone_name).isNotNull(), F.size(gone_name)), F.lit(0)).cast("long").alias(n_removed)]
    return joined.select(*[kept.alias(c) if c == "text" else F.col(c) for c in docs.columns], *counts)


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = remove_boilerplate(docs)
    return cleaned.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


QUERIES = {"op3_line_spread": op3_line_spread}

ORACLE_SQL = {
    "op3_line_spread": f"""
WITH lines AS (
  SELECT doc_id, source, text, pos, trim(string_split(text, chr(10))[pos]) AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)),
boiler AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.text, l.pos, b.line IS NOT NULL AND NOT (l.doc_id = b.first.d AND l.pos = b.first.p) AS gone
  FROM lines l LEFT JOIN boiler b ON l.line = b.line)
SELECT doc_id, coalesce(string_agg(string_split(text, chr(10))[pos], chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed
FROM marked GROUP BY doc_id, text
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""
}
