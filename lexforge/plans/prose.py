"""Queries over written dates, ranges, chains and loose labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import dates
from lexforge.operators import references
from lexforge.plans import domain
from lexforge.session import table


def _written(spark, sf):
    """A date in one of four languages for every order; some days are not in the calendar."""
    day = (F.col("o_orderkey") % 32).cast("string")
    month = (F.col("o_custkey") % 12).cast("int")
    lists = [F.get(F.array(*[F.lit(m[i]) for m in _NAMES]), month) for i in range(4)]
    name = F.when(F.col("o_orderkey") % 4 == 0, lists[0]).when(F.col("o_orderkey") % 4 == 1, lists[1]).when(F.col("o_orderkey") % 4 == 2, lists[2]).otherwise(lists[3])
    dot = F.when(F.col("o_orderkey") % 4 == 0, ". ").otherwise(" ")
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("vom "), day, dot, name, F.lit(" "), F.year("o_orderdate").cast("string")).alias("text"))


#: A German, French, Italian and English name of each month.
_NAMES = [(m[0], next(x for x in m if x in french), next(x for x in m if x in italian), m[-1]) for m, french, italian in zip(dates.MONTHS, ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"), ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"), strict=True)]


def iso_dates(spark, sf):
    return _written(spark, sf).select("o_orderkey", dates.iso(dates.parts(F.col("text"))).alias("date"))


def invalid_dates(spark, sf):
    rows = _written(spark, sf).select("o_orderkey", dates.impossible(dates.parts(F.col("text"))).alias("written"))
    return rows.where("written IS NOT NULL")


def pinpoint_ranges(spark, sf):
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("Urteil E. "), s("l_linenumber"), F.lit("."), (F.col("l_partkey") % 9).cast("string"), F.lit(" und "), (F.col("l_suppkey") % 7 + 1).cast("string"), F.when(F.col("l_partkey") % 2 == 0, "b").otherwise(""), F.lit(" sowie"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref_id"), text.alias("text"))
    return rows.select("ref_id", F.array_join(references.pinpoints(F.col("text")), ",").alias("pinpoints"))


def _chains(spark, sf):
    o = table(spark, sf, "orders")
    one, two = (F.col("o_orderkey") % 150 + 1).cast("string"), (F.col("o_custkey") % 150 + 1).cast("string")
    page = (F.col("o_orderkey") % 900 + 1).cast("string")
    return o.select(F.col("o_orderkey").alias("paragraph"), F.concat(F.lit("siehe BGE "), one, F.lit(" III "), page, F.lit("; "), two, F.lit(" II 7 und SJ "), F.year("o_orderdate").cast("string"), F.lit(" I "), page, F.lit(" sowie VB."), F.year("o_orderdate").cast("string"), F.lit("."), two, F.lit("; EGMR Nr. "), page, F.lit("/99")).alias("text"))


def continued_label(spark, sf):
    return _chains(spark, sf).select("paragraph", F.array_join(references.continued(F.col("text")), ",").alias("labels"))


def loose_labels(spark, sf):
    return references.loose_labels(_chains(spark, sf))


def application_numbers(spark, sf):
    return references.applications(_chains(spark, sf))


def paragraph_positions(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("document"), F.col("turn").alias("paragraph")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return references.positions(c)


def label_numbers(spark, sf):
    """References of an order numbered in the order of their lines, with their nth occurrence."""
    r = references.parsed(domain.references(spark, sf))
    rows = r.select((F.col("ref_id") / 10).cast("long").alias("document"), (F.col("ref_id") % 10).alias("paragraph"), F.lit(0).alias("start"), "label")
    return references.numbered(rows).select("document", "paragraph", "label", "number", "nth")


QUERIES = {f.__name__: f for f in (iso_dates, invalid_dates, pinpoint_ranges, continued_label, loose_labels, application_numbers, paragraph_positions, label_numbers)}

_DATES = """w AS (SELECT o_orderkey, (o_orderkey % 32) AS d, (o_custkey % 12) + 1 AS m, year(o_orderdate) AS y FROM orders),
t AS (SELECT o_orderkey, d, format('{:04d}-{:02d}-{:02d}', y, m, d) AS s FROM w), c AS (SELECT *, try_strptime(s, '%Y-%m-%d') AS p FROM t)"""
_CHAINS = """chains AS (SELECT o_orderkey AS paragraph, CAST(o_orderkey % 150 + 1 AS VARCHAR) AS one, CAST(o_custkey % 150 + 1 AS VARCHAR) AS two, CAST(o_orderkey % 900 + 1 AS VARCHAR) AS page, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)"""
ORACLE_SQL = {
    "iso_dates": f"WITH {_DATES} SELECT o_orderkey, CASE WHEN p IS NOT NULL THEN s END AS date FROM c",
    "invalid_dates": f"WITH {_DATES} SELECT o_orderkey, s AS written FROM c WHERE p IS NULL AND d BETWEEN 1 AND 31",
    "pinpoint_ranges": """SELECT l_orderkey AS ref_id, CASE WHEN a = b THEN a ELSE a || ',' || b END AS pinpoints FROM (
  SELECT l_orderkey, l_linenumber || '.' || (l_partkey % 9) AS a, (l_suppkey % 7 + 1) || CASE WHEN l_partkey % 2 = 0 THEN 'b' ELSE '' END AS b FROM lineitem)""",
    "continued_label": f"WITH {_CHAINS} SELECT paragraph, 'BGE ' || one || ' III ' || page || ',BGE ' || two || ' II 7' AS labels FROM chains",
    "loose_labels": f"""WITH {_CHAINS} SELECT paragraph, 0::BIGINT AS nth, 'SJ ' || y || ' I ' || page AS label, 'collection' AS kind FROM chains
UNION ALL SELECT paragraph, 1, 'VB.' || y || '.' || two, 'unknown_shape' FROM chains""",
    "application_numbers": f"WITH {_CHAINS} SELECT paragraph, page || '/99' AS number FROM chains",
    "paragraph_positions": """WITH c AS (SELECT conv_id AS document, turn AS paragraph, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL),
o AS (SELECT document, paragraph, coalesce(sum(length(text) + 1) OVER (PARTITION BY document ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", sum(length(text) + 1) OVER (PARTITION BY document) AS total FROM c)
SELECT document, paragraph, "offset", round("offset" / total::DOUBLE, 6) AS position FROM o""",
    "label_numbers": f"""WITH {domain.REFS_SQL}, r AS (SELECT ref_id // 10 AS document, ref_id % 10 AS paragraph, label FROM parsed)
SELECT document, paragraph, label, row_number() OVER (PARTITION BY document ORDER BY paragraph) - 1 AS number, row_number() OVER (PARTITION BY document, label ORDER BY paragraph) - 1 AS nth FROM r""",
}
