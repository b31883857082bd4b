"""Queries over the access log (the events table)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import changes, rollup
from lexforge.session import Scratch, table
from lexforge.sources import corpus


def _lines(spark, sf):
    e = table(spark, sf, "events")
    agent = F.when(F.col("user_id") % 10 == 0, "ExampleBot/1.0").otherwise("Mozilla/5.0")
    line = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_type") == "purchase", ' "POST ').otherwise(' "GET '), F.lit("/data/list?x="), F.col("event_id").cast("string"), F.lit('" '), F.when(F.col("event_id") % 9 == 0, "404").when(F.col("event_id") % 5 == 0, "304").otherwise("200"), F.lit(' 0.01 "'), agent, F.lit('"'))
    return e.select(line.alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def _admitted(spark, lines):
    excluded = spark.createDataFrame([("10.0.0.3 # own monitor",), ("# none",), ("10.0.0.4",)], "value string")
    return rollup.admitted(rollup.log_rows(lines), "/data/list", excluded, "2000-01-01").withColumn("bot", rollup.is_bot(F.col("agent")))


def _rows(spark, sf):
    return _admitted(spark, _lines(spark, sf))


def rotated_logs(spark, sf):
    """The rollup over three generations of one log, the oldest gzipped; its oldest day, whose head is gone, is left out."""
    lines, scratch = _lines(spark, sf), Scratch(spark)
    scratch.cut(lines.limit(0), "folder")
    for name, days, packed in (("access.log", "day >= '2024-01-21'", "none"), ("access.log.1", "day >= '2024-01-11' AND day < '2024-01-21'", "none"), ("access.log.2.gz", "day < '2024-01-11'", "gzip")):
        lines.where(days).select("value").write.option("compression", packed).text(f"{scratch.root}/logs/{name}")
    lines.limit(5).select("value").write.text(f"{scratch.root}/logs/other.log")
    rows = _admitted(spark, corpus.rotated_logs(spark, f"{scratch.root}/logs", "access.log"))
    return rollup.closed_days(rollup.daily(rows), rows, "9999-12-31")


def record_migration(spark, sf):
    """A record of which the older rows have three columns and an old header, with repeated days."""
    counts = rollup.daily(_rows(spark, sf))
    old = F.concat_ws("\t", "day", F.col("downloads").cast("string"), F.col("unique").cast("string"))
    lines = counts.where("day < '2024-01-16'").select(old.alias("value"))
    new = F.concat_ws("\t", old, F.col("bots").cast("string"))
    lines = lines.unionByName(counts.where("day >= '2024-01-11'").select(new.alias("value"))).unionByName(spark.createDataFrame([("day\tdownloads\tunique",), ("day\tdownloads\tunique\tbots",), ("",)], "value string"))
    return corpus.record_rows(lines)


def part_changes(spark, sf):
    """Conversations against a version in which every seventh turn is gone, every eleventh is there twice and others have moved."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("part"), "text")
    key = F.col("doc") * 10 + F.col("part")
    left = c.withColumn("k", key).where("k % 7 <> 0")
    text = F.when(F.col("k") % 13 == 0, F.concat("text", F.lit(" new"))).otherwise(F.col("text"))
    after = left.select("doc", F.when(F.col("k") % 5 == 0, F.col("part") + 100).otherwise(F.col("part")).alias("part"), text.alias("text"))
    return changes.changes(c, after.unionByName(after.where(key % 11 == 0)))


def daily_rollup(spark, sf):
    return rollup.daily(_rows(spark, sf))


def daily_spine(spark, sf):
    rows = _rows(spark, sf)
    return rollup.with_zero_days(rollup.daily(rows.where("day NOT LIKE '%5'")), rows)


def closed_days(spark, sf):
    rows = _rows(spark, sf)
    counts = rollup.daily(rows)
    last = rows.agg(F.max("day")).first()[0] or ""
    record = counts.where("day LIKE '%7'").select("day")
    return rollup.not_recorded(rollup.closed_days(counts, rows, last), record)


def freshness(spark, sf):
    o = table(spark, sf, "orders")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    live = o.agg(stamp(F.min("o_orderdate")).alias("generated")).withColumn("file", F.lit("a"))
    mirror = o.agg(stamp(F.max("o_orderdate")).alias("generated")).withColumn("file", F.lit("b"))
    return rollup.freshness(live, mirror, "2002-01-01T00:00:00Z")


QUERIES = {f.__name__: f for f in (daily_rollup, daily_spine, closed_days, freshness, rotated_logs, record_migration, part_changes)}

_ROWS = """rows AS (SELECT '10.0.0.' || user_id AS addr, strftime(ts, '%Y-%m-%d') AS day, user_id % 10 = 0 AS bot FROM events
  WHERE event_type <> 'purchase' AND event_id % 9 <> 0 AND user_id NOT IN (3, 4))"""
_DAILY = 'SELECT day, count(*) FILTER (WHERE NOT bot)::BIGINT AS downloads, count(DISTINCT CASE WHEN NOT bot THEN addr END)::BIGINT AS "unique", count(*) FILTER (WHERE bot)::BIGINT AS bots FROM rows'
ORACLE_SQL = {
    "daily_rollup": f"WITH {_ROWS} {_DAILY} GROUP BY day",
    "daily_spine": f"""WITH {_ROWS}, c AS ({_DAILY} WHERE day NOT LIKE '%5' GROUP BY day),
s AS (SELECT strftime(unnest(generate_series(min(CAST(day AS DATE)), max(CAST(day AS DATE)), INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM rows)
SELECT day, coalesce(downloads, 0)::BIGINT AS downloads, coalesce("unique", 0)::BIGINT AS "unique", coalesce(bots, 0)::BIGINT AS bots FROM s LEFT JOIN c USING (day)""",
    "closed_days": f"WITH {_ROWS} SELECT * FROM ({_DAILY} GROUP BY day) WHERE day < (SELECT max(day) FROM rows) AND day > (SELECT min(day) FROM rows) AND day NOT LIKE '%7'",
    "freshness": """WITH a AS (SELECT date_trunc('second', min(o_orderdate)) AS g1, date_trunc('second', max(o_orderdate)) AS g2 FROM orders)
SELECT CASE WHEN epoch(TIMESTAMP '2002-01-01' - g1) / 3600.0 > 48 THEN 'stale' WHEN g2 > g1 AND epoch(TIMESTAMP '2002-01-01' - g2) / 3600.0 > 6 THEN 'stuck' ELSE 'current' END AS verdict,
  round(epoch(TIMESTAMP '2002-01-01' - g1) / 3600.0, 3) AS age, round(epoch(TIMESTAMP '2002-01-01' - g2) / 3600.0, 3) AS mirror_age FROM a""",
    "rotated_logs": f"WITH {_ROWS} SELECT * FROM ({_DAILY} GROUP BY day) WHERE day > (SELECT min(day) FROM rows)",
    "record_migration": f"""WITH {_ROWS}, c AS ({_DAILY} GROUP BY day) SELECT day, downloads, "unique", CASE WHEN day >= '2024-01-11' THEN bots END AS bots FROM c""",
    "part_changes": """WITH c AS (SELECT conv_id AS doc, turn AS part, coalesce(text, '') AS text, conv_id * 10 + turn AS k FROM conversations),
a AS (SELECT doc, CASE WHEN k % 5 = 0 THEN part + 100 ELSE part END AS part, CASE WHEN k % 13 = 0 THEN text || ' new' ELSE text END AS text FROM c WHERE k % 7 <> 0),
d AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE (doc * 10 + part) % 11 = 0),
b AS (SELECT doc, sha256(text) AS digest, count(*) AS n, list_sort(list(part)) AS places FROM c GROUP BY ALL),
e AS (SELECT doc, sha256(text) AS digest, count(*) AS n, list_sort(list(part)) AS places FROM d GROUP BY ALL),
m AS (SELECT coalesce(b.doc, e.doc) AS doc, coalesce(b.digest, e.digest) AS digest, coalesce(b.n, 0)::BIGINT AS n_before, coalesce(e.n, 0)::BIGINT AS n_after, b.places AS p, e.places AS q FROM b FULL JOIN e ON b.doc = e.doc AND b.digest = e.digest)
SELECT doc, digest, n_before, n_after, CASE WHEN n_before = 0 THEN 'added' WHEN n_after = 0 THEN 'dropped' WHEN n_before < n_after THEN 'repeated' WHEN n_before > n_after THEN 'thinned' ELSE 'moved' END AS kind
FROM m WHERE n_before <> n_after OR p <> q""",
}
