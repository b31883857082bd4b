"""The daily rollup and the check of references as streams, with outputs that survive repeated batches."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_stream(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """day, downloads, unique, bots of a stream (at timestamp, addr, bot); a day is given once the watermark has passed its end.

    State is one number for each address of a day, dealt by address; a day itself is only the sum of these.
    """
    per = rows.withWatermark("at", delay).groupBy(F.window("at", "1 day"), "addr").agg(F.count_if(~F.col("bot")).alias("read"), F.count_if("bot").alias("bots"))
    person = (F.col("read") > 0) & F.col("addr").isNotNull()
    counts = per.groupBy(F.window("window", "1 day")).agg(F.sum("read").alias("downloads"), F.count_if(person).alias("unique"), F.sum("bots").alias("bots"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "downloads", "unique", "bots")


RECORD = "downloads long, unique long, bots long, day string"
#: The column by which a record is partitioned: a copy of the day, so that the day itself is read as it was written.
PART = "of_day"


def read_record(spark: SparkSession, path: str) -> DataFrame:
    """The days of a record, empty if there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(path).select("downloads", "unique", "bots", "day")


def record_days(days: DataFrame, path: str) -> None:
    """Add to a record the days that it does not have; each day is a partition that is replaced as a whole.

    Whatever a writer that was killed, or a second one, has left of these days is replaced, so a batch that is given
    again leaves one row a day. Days that were recorded before stay as they are.
    """
    spark = days.sparkSession
    new = days.join(read_record(spark, path).select("day").distinct(), "day", "left_anti")
    writer = new.withColumn(PART, F.col("day")).repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(PART).parquet(path)


def record_stream(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Record the days of a stream once each, batches that are given again included."""
    write = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return write.foreachBatch(lambda batch, _: record_days(batch, path)).trigger(availableNow=True).start()


class CurrentList:
    """A list that is looked for again between batches, at most every *seconds*, and kept as it is if that fails.

    *load* gives a version and the list; the list is taken anew only if the version is another one.
    """

    def __init__(self, load: Callable[[str | None], tuple[str, DataFrame | None]], seconds: float = 600, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.version: str | None = None
        self.rows: DataFrame | None = None
        self.looked = -math.inf
        self.stale = False

    def get(self) -> DataFrame:
        if self.clock() - self.looked >= self.seconds:
            self.looked = self.clock()
            try:
                version, rows = self.load(self.version)
            except Exception:
                if self.rows is None:
                    raise
                self.stale = True
            else:
                self.stale = False
                if rows is not None and version != self.version:
                    self.version, self.rows = version, rows
        return self.rows


def checked_stream(references: DataFrame, listed: CurrentList, check: Callable[[DataFrame, DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Check each batch of references against the list as it is then; a batch that is given again replaces its own results."""

    def run(batch: DataFrame, number: int) -> None:
        found = check(batch, listed.get()).withColumn("list", F.lit(listed.version)).withColumn("batch", F.lit(number))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return references.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()
