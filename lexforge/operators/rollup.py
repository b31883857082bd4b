"""Access logs by day: admission, bots, zero days, closed days, idempotent appends, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r'^(\S+) (\S+) "(\S+) (\S+)" (\d{3}) (\S+) "(.*)"$'
BOT = r"bot|crawl|spider|slurp|curl|wget|python-requests|monitor"


def log_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """addr, at, day, method, uri, status, agent of access-log lines; other lines are left out."""
    part = lambda i: F.regexp_extract(text, LINE, i)
    rows = lines.where(F.col(text).rlike(LINE)).select(part(1).alias("addr"), part(2).alias("at"), part(3).alias("method"), part(4).alias("uri"), part(5).cast("int").alias("status"), part(7).alias("agent"))
    return rows.withColumn("day", F.substring("at", 1, 10))


def admitted(rows: DataFrame, path: str, excluded: DataFrame | None = None, since: str = "") -> DataFrame:
    """Downloads: GET of *path* (a query string allowed) answered with 200 or 304, on a valid day from *since*, not by an excluded address."""
    good = (F.col("method") == "GET") & F.col("status").isin(200, 304) & (F.split_part("uri", F.lit("?"), F.lit(1)) == path) & F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("day") >= since)
    rows = rows.where(good)
    if excluded is None:
        return rows
    addresses = excluded.select(F.trim(F.regexp_replace("value", "#.*", "")).alias("addr")).where("addr <> ''").distinct()
    return rows.join(addresses, "addr", "left_anti")


def is_bot(agent: Column, name: Column | None = None, suffixes: tuple[str, ...] = ("googlebot.com", "search.msn.com")) -> Column:
    """By the user agent, or by the resolved name of the address (from a table resolved beforehand)."""
    by_agent = F.lower(agent).rlike(BOT)
    if name is None:
        return by_agent
    return by_agent | F.coalesce(F.lower(name).rlike("(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"), F.lit(False))


def daily(rows: DataFrame) -> DataFrame:
    """day, downloads, unique, bots of rows (day, addr, bot): people's downloads and addresses, and bots' downloads."""
    return rows.groupBy("day").agg(F.count_if(~F.col("bot")).alias("downloads"), F.count_distinct(F.when(~F.col("bot"), F.col("addr"))).alias("unique"), F.count_if("bot").alias("bots"))


def with_zero_days(counts: DataFrame, days: DataFrame) -> DataFrame:
    """The counts with zeros for the days between the first and the last of *days* that have none."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    spine = span.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day")).select(F.col("day").cast("string").alias("day"))
    return spine.join(counts, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "day"])


def closed_days(counts: DataFrame, days: DataFrame, today: str) -> DataFrame:
    """Days that are complete: not today, and not the oldest, whose head may have been rotated away."""
    first = days.agg(F.min("day").alias("first_day"))
    return counts.where(F.col("day") < today).join(F.broadcast(first), F.col("day") > F.col("first_day")).drop("first_day")


def not_recorded(counts: DataFrame, record: DataFrame) -> DataFrame:
    """Days that the record does not have; appending them twice changes nothing."""
    return counts.join(record.select("day").distinct(), "day", "left_anti")


def freshness(live: DataFrame, mirror: DataFrame, now: str, most_hours: float = 48.0, stuck_hours: float = 6.0) -> DataFrame:
    """One row: verdict (current, stale, stuck), age and lag in hours of a live manifest against its mirror."""
    hours = lambda c: (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))) / 3600.0
    both = live.select(F.col("generated").alias("g1"), F.col("file").alias("f1")).join(mirror.select(F.col("generated").alias("g2"), F.col("file").alias("f2")))
    stuck = (F.col("f1") != F.col("f2")) & (F.col("g2") > F.col("g1")) & (hours(F.col("g2")) > stuck_hours)
    verdict = F.when(hours(F.col("g1")) > most_hours, "stale").when(stuck, "stuck").otherwise("current")
    return both.select(verdict.alias("verdict"), F.round(hours(F.col("g1")), 3).alias("age"), F.round(hours(F.col("g2")), 3).alias("mirror_age"))
