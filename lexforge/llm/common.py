"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexforge.session import ship

#: Arrow batches are bounded by bytes as well as rows, so that a run of very long texts stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20
#: A key with more rows than this, and than this share of all rows, is hot. There are at most 1 / share hot keys.
HOT_ROWS, HOT_SHARE = 256, 1e-5

Columns = dict[str, list]


def bounded_batches(spark: SparkSession) -> None:
    """Get a session ready for the Python operators: small Arrow batches, and this package on the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_columns(df: DataFrame, run: Callable[[Iterator[Columns]], Iterable[Columns]], schema: str) -> DataFrame:
    """*run* over the batches of each task, which it sees and gives as {column: list of Python values}.

    Whole numbers stay whole beside nulls: unlike a pandas column, a list never turns ids into floats.
    """
    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ({name: column.to_pylist() for name, column in zip(b.schema.names, b.columns, strict=True)} for b in found)
        for columns in run(lists):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(batches, schema)


class Recent(dict):
    """A bounded memo in two generations: when the young one is full it becomes the old one, which is then forgotten.

    What is asked for again moves to the young one, so that frequent entries stay whatever else passes by. Long keys
    are not kept.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) >= self.longest:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def all(self, keys: list) -> list:
        """The values of *keys*."""
        found = list(map(self.get, keys))
        if None in found:
            found = [self[k] if f is None else f for k, f in zip(keys, found, strict=True)]
        return found


def hot_join(df: DataFrame, sized: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join of *df* (about *rows* rows) with *sized*, one row for each key with its number n of rows in *df*.

    The few hot keys are broadcast, so that their rows stay where they are; only the others are dealt by key.
    """
    hot = F.col("n") > max(HOT_ROWS, int(rows * HOT_SHARE))
    often = F.broadcast(sized.where(hot))  # 1 / HOT_SHARE rows at most
    return df.join(often, key).unionByName(df.join(often.select(key), key, "left_anti").join(sized.where(~hot), key))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as keep it apart from the columns of *df*."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
