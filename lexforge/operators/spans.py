"""Spans of texts against each other: free ones, choices without overlap, replacement of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.session import Scratch


def free(candidates: DataFrame, taken: DataFrame, by: str = "id") -> DataFrame:
    """Candidates (*by*, start, end and more) that share no place with any taken span (*by*, start, end).

    Both lie in one order of places: a candidate is hit by a taken span that begins before it and reaches into it, or by
    the next one that begins inside it. No pair of spans is formed.
    """
    both = candidates.withColumn("__taken", F.lit(False)).unionByName(taken.select(by, "start", "end", F.lit(True).alias("__taken")), allowMissingColumns=True)
    # At one place taken spans come first, so that the frame before a candidate holds them.
    before = Window.partitionBy(by).orderBy("start", F.desc("__taken"), "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(by).orderBy("start", F.desc("__taken"), "end").rowsBetween(1, Window.unboundedFollowing)
    reach = F.max(F.when(F.col("__taken"), F.col("end"))).over(before)
    following = F.min(F.when(F.col("__taken"), F.col("start"))).over(after)
    met = both.withColumn("__reach", F.coalesce(reach, F.lit(-1))).withColumn("__following", following)
    hit = (F.col("__reach") > F.col("start")) | F.coalesce(F.col("__following") < F.col("end"), F.lit(False))
    return met.where(~F.col("__taken") & ~hit).select(*candidates.columns)


def earliest_first(spans: DataFrame, by: str = "id") -> DataFrame:
    """Spans without overlap: by start, the longer first; what begins before the end of the last one kept is left out."""
    listed = spans.groupBy(by).agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("back")))).alias("all"))
    state = F.struct(F.array().cast("array<struct<start:int,back:int>>").alias("kept"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.array_append(a["kept"], s).alias("kept"), (-s["back"]).alias("at")))
    kept = listed.select(by, F.explode(F.aggregate("all", state, step, lambda a: a["kept"])).alias("s"))
    return spans.join(kept.select(by, F.col("s.start").alias("start"), (-F.col("s.back")).alias("end")), [by, "start", "end"])


#: Spans of a text up to which they are compared with those kept in the text's own row.
SMALL = 64


def widest_first(spans: DataFrame, by: str = "id", tie: str = "row", small: int = SMALL) -> DataFrame:
    """Spans without overlap, the widest first, ties to the lower *tie* (then the earlier start); empty spans are left out.

    Texts of at most *small* spans, repeated ones included, are chosen from span by span, each in its own row. Of longer
    ones widths are taken by octaves, the widest first: what overlaps a kept span of a wider octave goes by places in order.
    Within an octave the choice is made by local maxima: a span that beats all those it overlaps is kept, those that
    overlap a kept one go, and the rest is judged again. Spans meet in the cells of a grid as wide as the octave, so a
    span meets those around its place and never the whole text, however wide another span is.
    """
    scratch, columns = Scratch(spans.sparkSession), spans.columns
    size = F.col("end") - F.col("start")
    rank = F.struct((-size).alias("size"), F.col(tie).alias("tie"), F.col("start").alias("start"), F.col("end").alias("end"))
    read = scratch.cut(spans.where((size > 0) & F.col(by).isNotNull()), "spans")
    long = scratch.cut(read.groupBy(by).count().where(F.col("count") > small).select(by), "long")
    listed = read.join(long, by, "left_anti").groupBy(by).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.struct(*columns).alias("span")))).alias("all"))
    listed = listed.select(F.transform("all", lambda x: x["span"]).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    over = lambda kept, s: F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
    short = listed.select(F.inline(F.aggregate("all", none, lambda kept, s: F.when(over(kept, s), kept).otherwise(F.array_append(kept, s)))))
    if not long.limit(1).count():
        return short
    every = scratch.cut(read.join(long, by, "left_semi").dropDuplicates([by, "start", "end", tie]).withColumn("__rank", rank).withColumn("__octave", F.floor(F.log2(size + 0.5))), "every")
    kept = spans.limit(0)
    for octave in sorted((r[0] for r in every.select("__octave").distinct().collect()), reverse=True):  # 31 at most
        step = 2 << octave
        left = scratch.cut(free(every.where(F.col("__octave") == octave), kept.select(by, "start", "end"), by), "left")
        while left.limit(1).count():
            celled = left.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / step), F.floor((F.col("end") - 1) / step))))
            other = celled.select(F.col(by).alias("__by"), F.col("__cell").alias("__at"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("__rank").alias("__other"))
            meets = (F.col(by) == F.col("__by")) & (F.col("__cell") == F.col("__at")) & (F.col("start") < F.col("__end")) & (F.col("__start") < F.col("end"))
            judged = scratch.cut(celled.join(other, meets).groupBy(*columns, "__rank", "__octave").agg(F.min("__other").alias("__best")), "judged")
            won = judged.where(F.col("__best") == F.col("__rank"))
            kept = scratch.cut(kept.unionByName(won.select(*columns)), "kept")
            left = scratch.cut(free(judged.where(F.col("__best") != F.col("__rank")).drop("__best"), won.select(by, "start", "end"), by), "left")
    return short.unionByName(kept)


def still_reads(text: Column, start: Column, end: Column, written: Column) -> Column:
    """Whether a text has *written* at a span; other texts have changed since the span was shown."""
    return (F.substr(text, start + 1, end - start) == written) & (F.length(written) == end - start)


def replace_shown(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """id, text, applied, skipped: shown spans (id, start, end, written, label) replaced where the text still reads so.

    Spans that read otherwise or reach beyond the text are counted as skipped and left alone; of overlapping ones the
    earlier, then the longer, is applied.
    """
    whole = shown.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "written", "label"))).alias("all"))
    met = docs.select("id", "text").join(whole.hint("merge"), "id", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<start:int,back:int,written:string,label:string>>")))
    good = F.filter("all", lambda s: still_reads(F.col("text"), s["start"], -s["back"], s["written"]))
    met = met.withColumn("good", good)
    zero = F.lit(0).cast("long")
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), zero.alias("n"))
    between = lambda a, to: F.substr(F.col("text"), a["at"] + 1, to - a["at"])
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], between(a, s["start"]), s["label"]).alias("out"), (-s["back"]).alias("at"), (a["n"] + 1).alias("n")))
    done = met.withColumn("r", F.aggregate("good", state, step, lambda a: F.struct(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))).alias("text"), a["n"].alias("n"))))
    return done.select("id", "r.text", F.col("r.n").alias("applied"), (F.size("all") - F.col("r.n")).cast("long").alias("skipped"))
