"""The list of decisions: lines by key, duplicates, coverage, neighbours, ranges, suggestions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import keys
from lexforge.session import Scratch

LINE = ["key", "court", "canton", "date"]
#: References that ask alike travel in lists of at most so many.
GATHERED = 512


def valid_numbers(numbering: DataFrame) -> DataFrame:
    """decision_id, e: numbers of a listed form, trimmed and in lower case; others are left out."""
    e = F.trim(F.lower("e_number"))
    return numbering.select("decision_id", e.alias("e")).where(F.col("e").rlike(keys.ENUM)).distinct()


def labelled(decisions: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row for each label of a decision: both dockets, and the aliases of decisions that exist."""
    base = decisions.select("decision_id", F.coalesce("court", F.lit("")).alias("court"), F.coalesce("canton", F.lit("")).alias("canton"), F.substring(F.coalesce("decision_date", F.lit("")), 1, 10).alias("date"), "docket_number", "docket_number_2", F.coalesce("canonical_decision_id", "decision_id").alias("id"))
    own = base.select("decision_id", "court", "canton", "date", "id", F.explode(F.array("docket_number", "docket_number_2")).alias("docket"))
    other = aliases.select(F.col("canonical_decision_id").alias("decision_id"), F.translate("alias_docket_norm", "_", " ").alias("docket"))
    other = base.select("decision_id", "court", "canton", "date", "id").join(other, "decision_id").select(*own.columns)
    return keys.with_key(own.unionByName(other)).select(*LINE, "id", "decision_id")


def lines(decisions: DataFrame, numbering: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, court, canton, date, enums (natural order), id (the least) of every listed line."""
    rows = labelled(decisions, aliases)
    # Numbers are joined as one array a decision, so the lines' aggregation sees no row twice.
    numbers = valid_numbers(numbering).groupBy("decision_id").agg(F.collect_set("e").alias("es"))
    grouped = rows.join(numbers, "decision_id", "left").groupBy(*LINE).agg(F.flatten(F.collect_list("es")).alias("es"), F.min("id").alias("id"))
    return grouped.select(*LINE, keys.natural_sorted("es").alias("enums"), keys.clean_field(F.col("id")).alias("id"))


def listed(decisions: DataFrame, aliases: DataFrame) -> DataFrame:
    """:func:`lines` without their numbers, for what does not ask for these."""
    return labelled(decisions, aliases).groupBy(*LINE).agg(F.min("id").alias("id")).select(*LINE, keys.clean_field(F.col("id")).alias("id"))


def resolve_duplicates(rows: DataFrame) -> DataFrame:
    """Lines with the kind of duplicate each one is (null: kept) and the line it is merged into (target_*).

    A canton's copy of a federal judgment goes to the federal line of that date, else a line dated by its year to the
    earliest full date of the same court and year; a line that meets the first test is not given the second.
    """
    by_day, by_year = Window.partitionBy("key", "date"), Window.partitionBy("key", "court", "canton", "year")
    federal = F.col("court").isin(*keys.FEDERAL_COURTS)
    copy = F.col("key").rlike(keys.FEDERAL_KEY) & ~federal & ~F.col("canton").isin("", "CH")
    yearly = keys.year_only(F.col("date")) & ~copy
    rows = rows.withColumn("year", F.substring("date", 1, 4))
    rows = rows.withColumn("__federal", F.min(F.when(federal, F.struct("court", "canton"))).over(by_day)).withColumn("__dated", F.min(F.when(~keys.year_only(F.col("date")), F.col("date"))).over(by_year))
    kind = F.when(copy & F.col("__federal").isNotNull(), "cantonal_copy").when(yearly & F.col("__dated").isNotNull(), "year_only")
    rows = rows.withColumn("kind", kind)
    return rows.select(
        *LINE, "enums", "id", "kind",
        F.when(F.col("kind") == "cantonal_copy", F.col("__federal.court")).otherwise(F.col("court")).alias("target_court"),
        F.when(F.col("kind") == "cantonal_copy", F.col("__federal.canton")).otherwise(F.col("canton")).alias("target_canton"),
        F.when(F.col("kind") == "year_only", F.col("__dated")).otherwise(F.col("date")).alias("target_date"),
    )


def deduplicated(rows: DataFrame) -> DataFrame:
    """Lines without duplicates; the numbers of a dropped line go to the line that stays (chains are followed once)."""
    found = resolve_duplicates(rows)
    again = found.where("kind IS NOT NULL").select("key", F.col("court").alias("target_court"), F.col("canton").alias("target_canton"), F.col("date").alias("target_date"), F.struct(F.col("target_court").alias("c"), F.col("target_canton").alias("n"), F.col("target_date").alias("d")).alias("next"))
    moved = found.join(again, ["key", "target_court", "target_canton", "target_date"], "left")
    moved = moved.select("key", F.coalesce("next.c", "target_court").alias("court"), F.coalesce("next.n", "target_canton").alias("canton"), F.coalesce("next.d", "target_date").alias("date"), "enums", F.when(F.col("kind").isNull(), F.col("id")).alias("id"))
    merged = moved.groupBy(*LINE).agg(F.flatten(F.collect_list("enums")).alias("es"), F.min("id").alias("id"))
    return merged.where("id IS NOT NULL").select(*LINE, keys.natural_sorted("es").alias("enums"), "id")


def coverage(decisions: DataFrame, numbering: DataFrame) -> DataFrame:
    """For each court: decisions, those with a valid number, first and last full date, canton (the least)."""
    numbered = valid_numbers(numbering).select("decision_id").distinct().withColumn("__n", F.lit(1))
    rows = decisions.select("decision_id", F.coalesce("court", F.lit("")).alias("court"), F.coalesce("canton", F.lit("")).alias("canton"), F.substring(F.coalesce("decision_date", F.lit("")), 1, 10).alias("date")).join(numbered, "decision_id", "left")
    date = F.when(keys.full_date(F.col("date")), F.col("date"))
    return rows.groupBy("court").agg(F.min("canton").alias("canton"), F.count("*").alias("decisions"), F.count("__n").alias("with_numbering"), F.min(date).alias("first"), F.max(date).alias("last"))


def totals(decisions: DataFrame, numbering: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: decisions, labels, with_numbering."""
    a = decisions.agg(F.count("*").alias("decisions"))
    b = rows.agg(F.count("*").alias("labels"))
    c = decisions.join(valid_numbers(numbering).select("decision_id").distinct(), "decision_id", "left_semi").agg(F.count("*").alias("with_numbering"))
    return a.join(b).join(c)  # three aggregates of one row each


def absent_volumes(rows: DataFrame) -> DataFrame:
    """first, last and volume: the volumes between the first and the last without a line."""
    at = rows.select(keys.split_collection_key(F.col("key"))["volume"].alias("volume")).where("volume IS NOT NULL").distinct()
    span = at.agg(F.min("volume").alias("first"), F.max("volume").alias("last"))
    every = span.where("first IS NOT NULL").select("first", "last", F.explode(F.sequence("first", "last")).alias("volume"))
    return every.join(at, "volume", "left_anti").select("first", "last", "volume")


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """*left* beside the rows of *right* that are equal in *on*, nulls too; the other columns of both."""
    named = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    if how == "left_anti":
        return left.join(named, same, how)
    return left.join(named, same, how).drop(*[f"__{c}" for c in on])


def answered(references: DataFrame, answers: DataFrame, on: list[str]) -> DataFrame:
    """References beside the answers to what they ask (*on*, nulls are equal); what many of them ask is answered once."""
    return joined(references, answers, on, "inner")


def pair_tasks(spark: SparkSession) -> int:
    """Tasks for pairs, which are many times the rows that meet: their number does not follow the bytes of these."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, by: str) -> DataFrame:
    """*rows* dealt out as the lists of :func:`gathered` are, so that a join by *by* deals neither again."""
    return rows.repartition(pair_tasks(rows.sparkSession), by)


def gathered(references: DataFrame, on: list[str], by: str) -> DataFrame:
    """*on* and ``refs``, lists of at most ``GATHERED`` references that are equal in *on*, dealt out by *by* (one of *on*).

    A key of many references gives many lists, so no row grows with their number.
    """
    others = [c for c in references.columns if c not in on]
    rows = dealt(references.where(F.col(by).isNotNull()), by).sortWithinPartitions(*on)
    nth = F.floor(F.monotonically_increasing_id() / GATHERED)
    return rows.withColumn("__nth", nth).groupBy(*on, "__nth").agg(F.collect_list(F.struct(*others)).alias("refs")).drop("__nth")


def laid_out(found: DataFrame) -> DataFrame:
    """A row for each reference of ``refs``.

    The number of partitions stays; ``coalesce`` only keeps the join and the lists apart, so that a task holds the pairs
    of one list at a time and not those of all lists of a row.
    """
    return found.coalesce(pair_tasks(found.sparkSession)).select(*[c for c in found.columns if c != "refs"], F.inline("refs"))


def lookup(references: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """References beside every line under their key; *how* may be ``left_semi`` (listed) or ``left_anti`` (missing).

    Lines meet lists of references, which are laid out behind the join.
    """
    if how in ("left_semi", "left_anti"):
        rows = rows.select("key").distinct()  # each key once, so that a key of many lines is dealt out as one row
        return references.join(rows, "key", how)
    pairs = laid_out(dealt(rows, "key").join(gathered(references, ["key"], "key"), "key"))
    return pairs.select("key", *[c for c in references.columns if c != "key"], *[c for c in rows.columns if c != "key"])


def page_ranges(rows: DataFrame) -> DataFrame:
    """key, volume, part, first, last of the collection's decisions; last is null for a part's last decision."""
    at = rows.select("key").distinct().select("key", keys.split_collection_key(F.col("key")).alias("at")).where("at IS NOT NULL").select("key", "at.*")
    after = F.lead("page").over(Window.partitionBy("volume", "part").orderBy("page"))
    return at.select("key", "volume", "part", F.col("page").alias("first"), (after - 1).alias("last"))


def containing_page(pages: DataFrame, ranges: DataFrame, open_ended: int = 40) -> DataFrame:
    """Pages (volume, part, page) beside the decision that holds them; a part's last one counts for a few pages only.

    Each page asked for takes the last decision that starts at or before it, so no page meets all ranges of its part.
    """
    part = ["volume", "part"]
    starts = ranges.select(*part, F.col("first").alias("page"), F.struct("key", "first", "last").alias("range"))
    both = pages.select(*part, "page").distinct().unionByName(starts, allowMissingColumns=True)
    upto = Window.partitionBy(*part).orderBy("page").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("holds", F.last("range", ignorenulls=True).over(upto)).where("range IS NULL AND holds IS NOT NULL")
    inside = F.col("page") <= F.coalesce(F.col("last"), F.col("first") + open_ended)
    return pages.join(found.select(*part, "page", "holds.*").where(inside), [*part, "page"])


def neighbours(probes: DataFrame, rows: DataFrame) -> DataFrame:
    """probe, before, after: the last key below each probe and the first above, by bytes.

    Keys and probes are cut into even ranges of their order, written once; a probe looks into its own range by a window
    there and takes the edges of the ranges around it from a table with one row for each range.
    """
    none = F.lit(None).cast("string")
    listed = rows.select("key").distinct().select(F.col("key").alias("at"), "key", none.alias("probe"))
    asked = probes.select("probe").distinct().select(F.col("probe").alias("at"), none.alias("key"), "probe")
    dealt = listed.unionByName(asked).repartitionByRange("at").withColumn("range", F.spark_partition_id())
    both = Scratch(rows.sparkSession).cut(dealt, "neighbours")
    # As many rows as there are partitions, whatever the list holds: one task orders them, and they are broadcast.
    edges = both.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("range", F.desc("range")))
    edges = edges.select("range", F.last("high", ignorenulls=True).over(up).alias("below"), F.last("low", ignorenulls=True).over(down).alias("above"))
    # A probe that is listed itself must not find itself on either side.
    prior = Window.partitionBy("range").orderBy("at", F.col("probe").isNull())
    following = Window.partitionBy("range").orderBy(F.desc("at"), F.col("probe").isNull())
    found = lambda w: F.last("key", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = both.select("range", "probe", found(prior).alias("before"), found(following).alias("after")).where("probe IS NOT NULL")
    out = inside.join(F.broadcast(edges), "range")
    return out.select("probe", F.coalesce("before", "below").alias("before"), F.coalesce("after", "above").alias("after"))


_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _pool(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), F.split(F.lit(_DIGITS), "")).when(c.rlike("^[A-Z]$"), F.split(F.lit(_LETTERS), "")).otherwise(F.array().cast("array<string>"))


def one_edit_away(key: Column) -> Column:
    """All labels one typing error from *key*: a character replaced within its class, dropped, swapped or added."""
    n = F.length(key)
    char = lambda i: F.substr(key, i, F.lit(1))
    head = lambda i: F.substr(key, F.lit(1), i - 1)
    tail = lambda i: F.substr(key, i + 1, n)
    places = F.sequence(F.lit(1), n)
    replaced = F.flatten(F.transform(places, lambda i: F.transform(_pool(char(i)), lambda r: F.concat(head(i), r, tail(i)))))
    dropped = F.transform(F.filter(places, lambda i: char(i).rlike("^[0-9A-Z]$")), lambda i: F.concat(head(i), tail(i)))
    swaps = F.filter(places, lambda i: (i < n) & (char(i) != char(i + 1)))
    swapped = F.transform(swaps, lambda i: F.concat(head(i), char(i + 1), char(i), tail(i + 1)))
    around = lambda i: F.concat(F.when(i > 1, char(i - 1)).otherwise(F.lit("")), F.when(i <= n, char(i)).otherwise(F.lit("")))
    pool = lambda i: F.when(around(i).rlike("[0-9]"), F.split(F.lit(_DIGITS), "")).when(around(i).rlike("[A-Z]"), F.split(F.lit(_LETTERS), "")).otherwise(F.array().cast("array<string>"))
    added = F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.transform(pool(i), lambda r: F.concat(head(i), r, F.substr(key, i, n)))))
    return F.filter(F.array_distinct(F.concat(replaced, dropped, swapped, added)), lambda v: v != key)


def without_one(key: Column) -> Column:
    """The key and what is left of it without one character, each form once."""
    each = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(F.substr(key, F.lit(1), i - 1), F.substr(key, i + 1, F.length(key))))
    return F.array_distinct(F.array_append(each, key))


def one_edit(key: Column, other: Column) -> Column:
    """Whether *other* is one typing error from *key*: a character replaced within its class, dropped, swapped or added."""
    n, m = F.length(key), F.length(other)
    char = lambda s, i: F.substr(s, i, F.lit(1))
    cut = lambda s, i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s)))
    kind = lambda c: F.when(c.rlike("^[0-9]$"), 1).when(c.rlike("^[A-Z]$"), 2).otherwise(0)
    places = F.sequence(F.lit(1), F.greatest(n, m))
    replaced = F.exists(places, lambda i: (cut(key, i) == cut(other, i)) & (kind(char(key, i)) > 0) & (kind(char(key, i)) == kind(char(other, i))))
    swapped = F.exists(places, lambda i: (i < n) & (F.concat(F.substr(key, F.lit(1), i - 1), char(key, i + 1), char(key, i), F.substr(key, i + 2, n)) == other))
    dropped = F.exists(places, lambda i: (cut(key, i) == other) & (kind(char(key, i)) > 0))
    # An added character is of the class of a neighbour, a digit's before a letter's.
    around = lambda i: F.greatest(F.when(i > 1, kind(char(key, i - 1))).otherwise(0) % 2 * 3, F.when(i <= n, kind(char(key, i))).otherwise(0) % 2 * 3, F.when(i > 1, kind(char(key, i - 1))).otherwise(0), F.when(i <= n, kind(char(key, i))).otherwise(0))
    pool = lambda i: F.when(around(i) == 3, 1).when(around(i) == 2, 2).otherwise(-1)
    added = F.exists(places, lambda i: (cut(other, i) == key) & (kind(char(other, i)) == pool(i)))
    return (key != other) & F.when(n == m, replaced | swapped).when(m == n - 1, dropped).when(m == n + 1, added).otherwise(False)


def near_keys(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """key, variant: asked keys beside the listed ones that are one typing error away.

    Both sides are cut by one character, some fifteen forms each, and meet where a form is the same: keys of one error
    always do. What meets is judged by :func:`one_edit`.
    """
    left = asked.select("key").distinct().select("key", F.explode(without_one(F.col("key"))).alias("form"))
    right = listed.select(F.col("key").alias("variant")).distinct().select("variant", F.explode(without_one(F.col("variant"))).alias("form"))
    met = left.join(right, "form").where("key <> variant").select("key", "variant").distinct()
    return met.where(one_edit(F.col("key"), F.col("variant")))


def _first(rows: DataFrame, by: list[str], *order: Column | str, most: int) -> DataFrame:
    """The first *most* rows of each *by*, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def suggest(references: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """ref_id, rank, key, court, date, reason, score: listed lines one typing error from a missing label.

    A line with the written date counts most, then one that has the written number, then the named court; if any
    scores below 4 only those stay. Ties go by key, court, canton, date. Near keys are found once a label, and what many
    references ask is answered once. Lines of the written date are met by it; if there are none, all lines of a near key
    are alike but for their court and whether they have the number, so that the first few of each court, and of each court
    and number, stand for all of them. *references* and *rows* are read several times.
    """
    tried = near_keys(references, rows)
    scope = F.coalesce(keys.in_scope(F.col("courts"), F.col("canton"), F.col("row_court"), F.col("row_canton")), F.lit(False))
    place = ["variant", "row_court", "row_canton"]
    listed = rows.select(F.col("key").alias("variant"), F.col("court").alias("row_court"), F.col("canton").alias("row_canton"), "date", "enums")
    fields = ["key", "written_date", "pinpoint", "courts", "canton"]
    tie = [F.col(c) for c in ("score", "variant", "row_court", "row_canton", "date")]
    asked = references.select(*fields).distinct()
    # Lines of the written date: each is met by the questions of its day.
    dated = asked.where("written_date IS NOT NULL").join(tried, "key").join(listed.withColumn("written_date", F.col("date")), ["variant", "written_date"])
    has = F.coalesce(F.exists("enums", lambda e: (e == F.col("pinpoint")) | e.startswith(F.concat(F.col("pinpoint"), F.lit(".")))), F.lit(False))
    dated = dated.withColumn("score", F.when(has, 0).otherwise(2) + F.when(scope, 0).otherwise(1))
    same = _first(dated, fields, *tie, most=most).select(*fields, "variant", "row_court", "date", "score", "rank")
    # The others: lines of a court with the number come before those without it, so the first few of either kind are enough.
    open_ = asked.select("key", "pinpoint", "courts", "canton").distinct()
    leads = lambda e: F.transform(F.sequence(F.lit(1), F.size(F.split(e, "[.]"))), lambda i: F.call_function("substring_index", e, F.lit("."), i))
    numbers = listed.select(*place, "date", F.explode(F.array_distinct(F.flatten(F.transform("enums", leads)))).alias("pinpoint"))
    pinned = _first(numbers, [*place, "pinpoint"], "date", most=most).select(*place, "date", "pinpoint")
    plain = _first(listed, place, "date", most=most).select(*place, "date", "enums")
    near = open_.join(tried, "key")
    without = near.join(plain, "variant").where(~has).select(*open_.columns, *place, "date", F.lit(2).alias("pin"))
    both = near.join(pinned, ["variant", "pinpoint"]).select(*open_.columns, *place, "date", F.lit(0).alias("pin")).unionByName(without)
    both = both.withColumn("score", 4 + F.col("pin") + F.when(scope, 0).otherwise(1))
    other = _first(both, open_.columns, *tie, most=most).select(*open_.columns, "variant", "row_court", "date", "score", "rank")
    other = joined(joined(asked, same.select(*fields).distinct(), fields, "left_anti"), other, open_.columns, "inner")
    found = same.unionByName(other)
    reason = F.when(F.col("score") < 4, "one_character_same_date").otherwise("one_character")
    met = answered(references.select("ref_id", *fields), found, fields)
    return met.select("ref_id", F.col("rank").cast("long").alias("rank"), F.col("variant").alias("key"), F.col("row_court").alias("court"), "date", reason.alias("reason"), F.col("score").cast("long").alias("score"))


def date_suggestions(references: DataFrame, rows: DataFrame, most: int = 3) -> DataFrame:
    """ref_id, rank, key, court, date: for a listed label of which no date fits, lines of that date one typing error away.

    The number may be the error and not the date. Near keys are found once a label, then asked for their lines of the
    written date, once for all references that ask alike. Ties go by scope, key, court, canton.
    """
    listed = rows.select(F.col("key").alias("variant"), F.col("court").alias("row_court"), F.col("canton").alias("row_canton"), F.col("date").alias("written_date"))
    fields = ["key", "written_date", "courts", "canton"]
    asked = references.select(*fields).where("written_date IS NOT NULL").distinct()
    met = asked.join(near_keys(references, rows), "key").join(listed, ["variant", "written_date"])
    outside = ~F.coalesce(keys.in_scope(F.col("courts"), F.col("canton"), F.col("row_court"), F.col("row_canton")), F.lit(False))
    order = Window.partitionBy(*fields).orderBy(outside, "variant", "row_court", "row_canton")
    ranked = met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return joined(references.select("ref_id", *fields), ranked, fields, "inner").select("ref_id", "rank", F.col("variant").alias("key"), F.col("row_court").alias("court"), F.col("written_date").alias("date"))


def other_part(references: DataFrame, rows: DataFrame) -> DataFrame:
    """Collection references beside listed decisions of the same volume and page in another part."""
    asked = keys.computed(rows.select("key").distinct(), keys.split_collection_key(F.col("key")).alias("at")).where("at IS NOT NULL")
    asked = asked.select(F.col("key").alias("listed"), "at.*", F.explode(F.array(*map(F.lit, keys.PARTS))).alias("other")).where("other <> part")
    # Each listed key tells once which labels mean it by another part; references are joined by their own key.
    asked = asked.select("listed", keys.collection_key(F.col("volume"), F.col("other"), F.col("page")).alias("asked"))
    lines = rows.select(F.col("key").alias("listed"), "court", "date").join(asked, "listed")
    return references.select("ref_id", F.col("key").alias("asked")).join(lines, "asked").select("ref_id", F.col("listed").alias("key"), "court", "date")


def collection_suggestions(references: DataFrame, rows: DataFrame, most: int = 4) -> DataFrame:
    """ref_id, rank, key, court, date, reason: listed decisions that a missing label of the collection may mean.

    First the decision that holds the cited page, then all lines of that volume and page in other parts, in the parts'
    order, then keys with one digit of volume or page changed or two swapped, one line each. Ties go by key, court,
    canton, date. Labels are answered once and then joined to their references.
    """
    at = references.select("key").distinct().select(F.col("key").alias("asked"), keys.split_collection_key(F.col("key")).alias("at"))
    asked = at.where("at IS NOT NULL").select("asked", "at.*")
    lines = rows.where("key LIKE 'BGE %'").select("key", "court", "canton", "date")
    holding = containing_page(asked, page_ranges(lines)).select("asked", "key", F.lit(0).alias("source"), F.lit(0).alias("place"))
    parts = asked.select("*", F.posexplode(F.array(*map(F.lit, keys.PARTS))).alias("place", "other")).where("other <> part")
    parts = parts.select("asked", keys.collection_key(F.col("volume"), F.col("other"), F.col("page")).alias("key"), F.lit(1).alias("source"), "place")
    digits = F.format_string("%03d%04d", "volume", "page")
    typed = asked.select("asked", "part", F.explode(F.filter(one_edit_away(digits), lambda v: v.rlike(r"^\d{7}$"))).alias("v"))
    typed = typed.select("asked", keys.collection_key(F.substring("v", 1, 3), F.col("part"), F.substring("v", 4, 4)).alias("key"), F.lit(2).alias("source"), F.lit(0).alias("place"))
    tried = holding.unionByName(parts.unionByName(typed).join(lines.select("key").distinct(), "key", "left_semi"))
    tried = tried.groupBy("asked", "key").agg(F.min(F.struct("source", "place")).alias("by")).select("asked", "key", "by.*")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("court", "canton", "date"))
    met = tried.join(lines.withColumn("nth", nth), "key").where("nth = 1 OR source = 1")
    order = Window.partitionBy("asked").orderBy("source", "place", "key", "court", "canton", "date")
    ranked = met.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    reason = F.get(F.array(*map(F.lit, ("contains_page", "other_part", "one_character"))), F.col("source"))
    answers = ranked.select("asked", "rank", F.col("key").alias("found"), "court", "date", reason.alias("reason"))
    met = references.select("ref_id", F.col("key").alias("asked")).join(answers, "asked")
    return met.select("ref_id", "rank", F.col("found").alias("key"), "court", "date", "reason")


def joined_applications(references: DataFrame, rows: DataFrame) -> DataFrame:
    """References to an application number that is listed only as the first of several joined ones (``a/b_c/d``).

    Pairs are many times the rows that meet, so both sides are dealt to a number of tasks that does not follow their bytes.
    """
    tasks = pair_tasks(rows.sparkSession)
    first = rows.select(F.col("key").alias("listed"), F.substring_index("key", "_", 1).alias("head")).where("head <> listed").repartition(tasks, "head")
    return references.repartition(tasks, "key").join(first, F.col("key") == F.col("head")).select("ref_id", "key", "listed")


def cover(pinpoint: Column, e: Column) -> Column:
    """Whether a listed number is *pinpoint* or lies below it."""
    return (e == pinpoint) | (e.startswith(pinpoint) & F.substr(e, F.length(pinpoint) + 1, F.lit(1)).rlike("^[.a-z/]$"))


def pinpoint_parent(pinpoint: Column) -> Column:
    """The number above a lettered one (``3c/aa`` has 3); null if it is not lettered."""
    parent = F.regexp_replace(F.substring_index(pinpoint, "/", 1), "[a-z]+$", "")
    return F.when((parent != pinpoint) & (parent != ""), parent)


def covered(enums: Column) -> Column:
    """All numbers that are listed or have a listed one below them: those of which :func:`cover` holds for some of *enums*."""
    above = lambda e: F.transform(F.filter(F.sequence(F.lit(1), F.length(e)), lambda i: F.substr(e, i, F.lit(1)).rlike("^[.a-z/]$")), lambda i: F.substr(e, F.lit(1), i - 1))
    return F.array_distinct(F.flatten(F.transform(enums, lambda e: F.array_append(above(e), e))))


def pinpoint_state(pinpoint: Column, enums: Column, known: Column | None = None, parent: Column | None = None) -> Column:
    """exists, parent_only, no_structure or absent.

    Where many numbers are asked of many lines, *known* is :func:`covered` of the line and *parent* is
    :func:`pinpoint_parent` of the number, each found once.
    """
    parent = pinpoint_parent(pinpoint) if parent is None else parent
    return (
        F.when(F.size(enums) == 0, "no_structure")
        .when(F.exists(enums, lambda e: cover(pinpoint, e)) if known is None else F.array_contains(known, pinpoint), "exists")
        .when(F.coalesce(F.array_contains(enums, F.coalesce(parent, F.lit("\0"))), F.lit(False)), "parent_only")
        .otherwise("absent")
    )


def stem(pinpoint: Column) -> Column:
    """A number up to its last full stop: the place where its siblings are."""
    return F.regexp_extract(pinpoint, r"^(.*[.])", 1)


def nearby(pinpoint: Column, enums: Column, most: int = 14) -> Column:
    """struct(numbers, more): what is listed at the place of an absent number: its siblings, else the top level."""
    return nearby_stem(stem(pinpoint), enums, most)


def nearby_stem(stem: Column, enums: Column, most: int = 14) -> Column:
    """As :func:`nearby` for any number of that :func:`stem`."""
    level = lambda prefix, n: F.array_distinct(F.transform(F.filter(enums, lambda e: e.startswith(prefix) & (F.size(F.split(e, "[.]")) >= n)), lambda e: F.regexp_replace(F.array_join(F.slice(F.split(e, "[.]"), F.lit(1), n), "."), "/.*$", "")))
    once = lambda x, then: F.transform(F.array(x), then)[0]  # noqa: E731  # a value that is used several times
    siblings = F.when(stem != "", level(stem, F.size(F.split(stem, "[.]")))).otherwise(F.array().cast("array<string>"))
    found = once(siblings, lambda s: F.when(F.size(s) > 0, s).otherwise(level(F.lit(""), F.lit(1))))
    return once(found, lambda f: F.struct(F.slice(f, 1, most).alias("numbers"), (F.size(f) > most).alias("more")))


def with_levels(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Lines with ``levels``: what :func:`nearby_stem` gives for each stem that numbers asked of their key (key, pin) have.

    Numbers of one stem have the same neighbours, so these are found once a line and stem, not for each number.
    """
    stems = asked.select("key", stem(F.col("pin")).alias("stem")).where("stem IS NOT NULL").groupBy("key").agg(F.collect_set("stem").alias("stems"))
    met = rows.join(stems, "key")
    levels = F.map_from_entries(F.transform("stems", lambda s: F.struct(s, nearby_stem(s, F.col("enums")))))
    return keys.computed(met, levels.alias("levels")).drop("stems")
