"""Operator 6: document fingerprints by a threshold-scaled sketch.

Of all shingle hashes of a text those below a fixed fraction of the hash range are kept, and nothing else. The sketch of
a union is therefore the union of the sketches, and the share of one sketch that is found in another estimates
containment even between texts of very unequal length. Shingles are runs of code points.

A short text would have too few hashes below the fraction, so a sketch states its fraction: that of long texts is one
in SCALE, and a text with fewer distinct shingles takes the smallest power of two that still keeps LEAST hashes or more
by expectation, down to all of them. Sketches of unlike fractions are compared and merged at the smaller one: of the
fuller sketch the hashes below it are taken, which are just what it would have kept.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, bounded_batches, map_columns
from lexforge.session import table

#: Code points of a shingle (a power of two); one hash in SCALE is kept, or more of them where that would be fewer than LEAST.
SHINGLE, SCALE, LEAST = 16, 16, 256
#: Hashes are written with this many bytes.
WIDTH = 6

_MULTIPLIER = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes, so that all bits depend on all of the shingle."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles, built by doubling; a shorter text is one shingle, an empty one has none."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    if not len(h):
        return h
    if len(h) < size:
        h = np.concatenate([h, np.zeros(size - len(h), dtype=np.uint64)])
    step = 1
    while step < size:
        h = h[:-step] * np.uint64(pow(_MULTIPLIER, step, 1 << 64)) + h[step:]
        step *= 2
    return _mix(h)


class Sketch(NamedTuple):
    """The sorted distinct hashes (their upper WIDTH bytes) that are below a fraction, 1 / scale, of the range."""

    scale: int
    hashes: np.ndarray

    def at(self, scale: int) -> np.ndarray:
        """The hashes that a sketch of the same text with this scale (not below the own one) has."""
        return self.hashes[: np.searchsorted(self.hashes, (1 << 8 * WIDTH) // scale)] if scale > self.scale else self.hashes


def sketch(text: str, scale: int = SCALE, size: int = SHINGLE) -> Sketch:
    """The sketch of a text; an empty one has no hashes."""
    h = shingle_hashes(text, size) >> np.uint64(64 - 8 * WIDTH)
    if len(h) < 2 * scale * LEAST:  # else there may still be few distinct ones, which the hashes kept tell
        h = np.unique(h)
        scale = own_scale(len(h), scale)
    found = np.unique(h[h < (1 << 8 * WIDTH) // scale])
    if len(found) < LEAST and scale > 1:
        h = np.unique(h)
        scale = own_scale(len(h), scale)
        found = h[h < (1 << 8 * WIDTH) // scale]
    return Sketch(scale, found)


def own_scale(distinct: int, scale: int = SCALE) -> int:
    """The scale of a text with so many distinct shingles: it halves whenever fewer than LEAST hashes would be kept."""
    while scale > 1 and distinct < scale * LEAST:
        scale //= 2
    return scale


def encode(s: Sketch) -> str:
    """Scale, a point, and the hashes in base64."""
    raw = s.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes() if len(s.hashes) else b""
    return f"{s.scale}.{base64.b64encode(raw).decode()}"


def decode(fingerprint: str) -> Sketch:
    scale, _, hashes = fingerprint.partition(".")
    raw = np.frombuffer(base64.b64decode(hashes), dtype=np.uint8).reshape(-1, WIDTH)
    return Sketch(int(scale), np.concatenate([np.zeros((len(raw), 8 - WIDTH), dtype=np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.uint64))


def merge(a: str, b: str) -> str:
    """The fingerprint of the shingles of two texts taken together, at the smaller fraction of both."""
    s, t = decode(a), decode(b)
    scale = max(s.scale, t.scale)
    return encode(Sketch(scale, np.union1d(s.at(scale), t.at(scale))))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated containment of the smaller text in the other, at the smaller fraction of both.

    1 for two empty texts, 0 for an empty and another one, and where the smaller has no hash below the fraction.
    """
    scale = max(a.scale, b.scale)
    x, y = a.at(scale), b.at(scale)
    if not len(x) or not len(y):
        return float(len(a.hashes) == len(b.hashes) == 0)
    return len(np.intersect1d(x, y, assume_unique=True)) / min(len(x), len(y))


def edited(text: str, following: str) -> str:
    """*text* with its last half replaced by as much of the start of *following*."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, scale: int = SCALE, size: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint of every row's whole text (null: empty), however long; rows are kept as they are; no shuffle."""

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "fingerprint": [encode(sketch(t, scale, size)) for t in batch["text"]]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_columns(rows, run, "doc_id long, fingerprint string")


_LOWEST = -(1 << 63)


def _edges(quantiles: list[float]) -> list[tuple[int, int]]:
    """Lower edges (id, hash) of ranges. An id that fills several quantiles is cut into as many by the hash of its texts."""
    edges = []
    for value, times in sorted(Counter(int(q) for q in quantiles).items()):
        edges += [(value, _LOWEST + k * ((1 << 64) // times)) for k in range(times)]
    return edges


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, bucket, copy) dealt into ranges of descending doc_id, each closed by the row that follows it.

    The ranges are cut at quantiles of the ids (an id with very many rows by a hash of their texts too) and the first
    place in each is known from a scan without texts moved, so only one row for each range is sent twice and texts move
    once. Within a partition rows are sorted by range and place.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    count = 3 * parts  # several ranges in a partition even out their sizes
    # Quantiles of whole numbers beyond 2^53 come rounded; an edge may lie anywhere.
    edges = _edges(rows.approxQuantile("id", [i / count for i in range(1, count)], 0.2 / count)) if count > 1 else []

    @F.pandas_udf("int")
    def bucket_of(id: pd.Series, hash: pd.Series) -> pd.Series:
        return pd.Series([len(edges) - bisect_right(edges, at) for at in zip(id.tolist(), hash.tolist(), strict=True)], dtype="int32")

    dealt = rows.withColumn("bucket", bucket_of("id", "hash"))
    # At most *count* rows: the first place of each range.
    firsts = [(r["bucket"], *r["first"]) for r in dealt.groupBy("bucket").agg(F.max(F.struct("id", "hash")).alias("first")).orderBy("bucket").collect()]
    if not firsts:
        return dealt.select("doc_id", "text", "bucket", F.lit(False).alias("copy"))
    # The first row of a range closes the range before it.
    sent = spark.createDataFrame([(i, h, firsts[n - 1][0]) for n, (_, i, h) in enumerate(firsts)], "id long, hash long, to int")
    own = F.struct(F.col("bucket"), F.lit(False).alias("copy"))
    places = F.array_compact(F.array(own, F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("bucket"), F.lit(True).alias("copy")))))
    placed = dealt.join(F.broadcast(sent), ["id", "hash"], "left").select("doc_id", "id", "hash", "text", F.explode(places).alias("place"))
    placed = placed.select("doc_id", "id", "hash", "text", "place.bucket", "place.copy")
    return placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "copy", F.desc("id"), F.desc("hash"), "text").drop("id", "hash")


def edited_fingerprints(docs: DataFrame, scale: int = SCALE, size: int = SHINGLE) -> DataFrame:
    """One row for each document: its fingerprint, that of its edited text, and the likeness to both neighbours.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document
    is the one with the next smaller doc_id (after the last: the first; a single row follows itself). Rows with equal
    ids follow each other in the order of a hash of their texts; null ids come last. Null texts are empty, very long
    ones are sketched whole, an empty table gives no rows, and other columns are ignored whatever their names.
    """

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        held = None  # (doc_id, text, sketch, bucket) that waits for its next
        for batch in batches:
            rows = []
            for doc_id, text, bucket, copy in zip(batch["doc_id"], batch["text"], batch["bucket"], batch["copy"], strict=True):
                own = sketch(text, scale, size)
                if held is not None and held[3] == bucket:
                    changed = edited(held[1], text)
                    other = sketch(changed, scale, size)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((held[0], len(held[1]), digest, encode(held[2]), encode(other), likeness(held[2], other), likeness(held[2], own)))
                held = None if copy else (doc_id, text, own, bucket)
            yield {name: [r[i] for r in rows] for i, name in enumerate(names)}

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_columns(with_next(docs), run, schema)


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op6_scaled_sketch": op6_scaled_sketch}
