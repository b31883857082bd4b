"""Operator 10: near-duplicate documents by MinHash, with exact links and connected components.

1. Every text's shingle set gets a signature of minima under many universal hash functions and a key of its own; rows
   with equal sets form a class, and only one row of each class goes on.
2. Bands of the signature deal the classes into buckets. A class is compared with the bucket head it shares most
   bands with, on full shingle sets, in blocks of bounded size; this exact check replaces signature verification.
3. Links become components by alternating large-star and small-star. Buckets that still hold several components are
   searched again: members of one against all members of the other, block by block, so that no pair which shares a
   bucket stays untested unless it is connected already. Rows name a block that they ask, never a partner.

Members of hot buckets and components are dealt over blocks, and rows of hot keys are not dealt by them; classes, links
and components stay in tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, Recent, bounded_batches, hot_join, map_columns, unused
from lexforge.session import Scratch, table

#: Words of a shingle and the least similarity in hundredths, unless a caller has others.
SHINGLE, PERCENT = 5, 80
#: Bands and rows of each. At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^6)^32 = 6e-5, and
#: unlike texts (below 0.1) share one with less than 4e-5, so that chance buckets stay rare among many documents.
BANDS, ROWS = 32, 6
#: Members of a block that is compared at once, and the blocks whose rows may ask it in one task.
BLOCK, ASKING = 256, 4
#: A table of up to so many narrow rows (at most 64 bytes each) is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 200_000
#: Words whose hashes a worker keeps (twice as many at most).
KEPT_WORDS = 400_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20_240_601)
#: The universal family x -> (a x + b) mod 2^32 with odd a, over 32 bits of a shingle's hash; its values are mixed
#: before the minimum is taken.
_A = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_A32, _B32 = (_A >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_B >> np.uint64(31)).astype(np.uint32)



def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


_hashes = Recent(_word_hash, KEPT_WORDS, 48)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are runs without ASCII white space, A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(_hashes.all(words), dtype=np.uint64)
    if len(h) < size:
        out = np.full(1, len(h), dtype=np.uint64)
        for value in h:
            out = out * _MULTIPLIER + value
    else:
        out = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            out = out * _MULTIPLIER + h[i : len(h) - size + 1 + i]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(hashes: np.ndarray) -> bytes:
    """Minima of all hash functions over a set, as 32-bit numbers."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 512):
        y = x[None, i : i + 512] * _A32[:, None]
        y += _B32[:, None]
        y ^= y >> np.uint32(15)
        np.minimum(best, (y * np.uint32(0x2C1B3C6D)).min(axis=1), out=best)
    return best.astype("<u4").tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id (null ids: none), a hash of the text and the text (null: empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.withColumn("body", F.xxhash64("text"))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, body, n (size of the set), k1, k2 (key of the set, null if empty) and sig of every row."""

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            out: Columns = {"id": b["id"], "body": b["body"], "n": [], "k1": [], "k2": [], "sig": []}
            for text in b["text"]:
                h = shingles(text, size)
                k1, k2 = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), dtype="<i8").tolist() if len(h) else (None, None)
                for name, value in (("n", len(h)), ("k1", k1), ("k2", k2), ("sig", signature(h) if len(h) else None)):
                    out[name].append(value)
            yield out

    return map_columns(_keyed(docs), run, "id long, body long, n long, k1 long, k2 long, sig binary")


def _small(df: DataFrame) -> DataFrame:
    """*df* with a broadcast hint if a count proves it small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def block_links(docs: DataFrame, places: DataFrame, size: int, percent: int, one_each: bool) -> DataFrame:
    """Links (u, v) found by comparing, in each (kind, g, block, part), every row of role 1 with all rows of role 0.

    *places* holds (kind, g, block, part, role, id, body, comp); the sets are made from the texts of *docs*. Rows of one
    component are not compared. With *one_each*, one link is given for each row of role 1 and component it meets.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = pa.array([shingles(t, size).tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), hashes], ["id", "at", "hashes"])

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, comps, arrays, index = None, [], [], [], None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for kind, g, block, part, role, i, comp, raw in batch.itertuples(index=False, name=None):
                if (kind, g, block, part) != at:
                    at, ids, comps, arrays, index = (kind, g, block, part), [], [], [], None
                own = np.frombuffer(raw, dtype=np.uint64)
                if role == 0:
                    ids.append(i), comps.append(comp), arrays.append(own)
                    continue
                if not ids:
                    continue
                if index is None:
                    lengths = np.array([len(a) for a in arrays])
                    values, owners = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), lengths)
                    order = np.argsort(values)
                    index = (values[order], owners[order], lengths, np.array(ids), np.array(comps))
                values, owners, lengths, all_ids, all_comps = index
                low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                count = high - low
                rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                common = np.bincount(owners[rows], minlength=len(lengths))
                good = np.flatnonzero((100 * common >= percent * (len(own) + lengths - common)) & (all_comps != comp))
                if one_each and len(good):
                    good = good[np.unique(all_comps[good], return_index=True)[1]]
                found.extend((max(i, j), min(i, j)) for j in all_ids[good].tolist())
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    # A text is read and hashed once, then sent to its places.
    at = places.groupBy("id", "body").agg(F.collect_list(F.struct("kind", "g", "block", "part", "role", "comp")).alias("at"))
    made = _keyed(docs).join(_small(at), ["id", "body"]).select("id", "at", "text").mapInArrow(sets, f"id long, at array<struct<{_PLACE}>>, hashes binary")
    made = made.select("id", "hashes", F.explode("at").alias("p")).select("p.kind", "p.g", "p.block", "p.part", "p.role", "id", "p.comp", "hashes")
    dealt = made.repartition("kind", "g", "block", "part").sortWithinPartitions("kind", "g", "block", "part", "role")
    return dealt.mapInPandas(links, "u long, v long").where("u <> v").distinct()


_PLACE = "kind:int,g:bigint,block:int,part:int,role:int,comp:bigint"


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id and comp (the least id it is connected with) of all ends of *edges* (u > v), by alternating star steps."""
    now = scratch.cut(edges, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.cut(small.unionByName(first.select("u", F.col("m").alias("v"))).distinct(), "stars")
        scratch.drop(now)
        now = new
        roots = now.select("v").distinct()
        # Stars: nobody has two centres, and no centre hangs on another.
        count = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("k")).first()
        if count["n"] == count["k"] and now.join(roots.withColumnRenamed("v", "u"), "u", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("comp")))


def _candidates(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """key, id, body, head and head_body of the members of all buckets with two classes or more; the head is the least id."""
    width = 4 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    members = reps.select("id", "body", F.explode(bands).alias("key"))
    heads = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "body")).alias("head")).where("n > 1")
    met = hot_join(members, scratch.cut(heads, "heads"), "key", BANDS * reps.count())
    return met.select("key", "id", "body", F.col("head.id").alias("head"), F.col("head.body").alias("head_body"))


def _blocks(n) -> F.Column:
    return F.ceil(n / F.lit(BLOCK)).cast("int")


def _dealt(id_column: str, blocks) -> F.Column:
    return F.pmod(F.xxhash64(id_column), blocks.cast("long")).cast("int")


def _upto(last) -> F.Column:
    return F.explode(F.sequence(F.lit(0), last))


def _star_places(cand: DataFrame, scratch: Scratch) -> DataFrame:
    """Each member beside the head that it shares most buckets with (ties: the least id)."""
    shared = cand.where("id <> head").groupBy("id", "body", "head", "head_body").agg(F.count("*").alias("n"))
    best = shared.groupBy("id", "body").agg(F.max(F.struct("n", (-F.col("head")).alias("order"), "head", "head_body")).alias("best")).select("id", "body", "best.head", "best.head_body")
    best = scratch.cut(best, "best")
    sizes = scratch.cut(best.groupBy("head").agg(F.count("*").alias("n")), "sizes")
    members = hot_join(best, sizes, "head", best.count()).select("id", "body", "head", "head_body", _dealt("id", _blocks(F.col("n"))).alias("block"))
    # One head asks each block, so a block needs no parts.
    kind, part = F.lit(0).alias("kind"), F.lit(0).alias("part")
    main = members.select(kind, F.col("head").alias("g"), "block", part, F.lit(0).alias("role"), "id", "body", F.col("id").alias("comp"))
    ask = members.select("head", "head_body", "block").distinct()
    return main.unionByName(ask.select(kind, F.col("head").alias("g"), "block", part, F.lit(1).alias("role"), F.col("head").alias("id"), F.col("head_body").alias("body"), F.col("head").alias("comp")))


def _rest_places(cand: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets that hold several components, beside all members of the other components there."""
    counts = scratch.cut(comps.groupBy("comp").agg(F.count("*").alias("n")), "sizes")
    sized = hot_join(comps, counts, "comp", comps.count()).select("id", "comp", F.col("n").alias("size"))
    known = cand.select("key", "id", "body").join(sized, "id", "left")
    known = scratch.cut(known.select("key", "id", "body", F.coalesce("comp", "id").alias("comp"), "size"), "known")
    mixed = known.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    rest = scratch.cut(hot_join(known, scratch.cut(mixed, "mixed"), "key", known.count()).drop("n"), "rest")
    rows = rest.count()
    # Against components of several classes: all members of each, once. Of two such components the smaller one asks.
    there = rest.where("size IS NOT NULL").groupBy("key", F.col("comp").alias("g"), F.col("size").alias("gn")).agg(F.lit(1).alias("one"))
    there = there.groupBy("key").agg(F.collect_list(F.struct("g", "gn")).alias("there"))
    each = rest.groupBy("key").agg(F.count("*").alias("n")).join(there, "key")  # one row a bucket, with its components
    met = hot_join(rest, scratch.cut(each, "there"), "key", rows).select("id", "body", "comp", "size", F.explode("there").alias("t")).select("*", "t.*")
    ask = met.where("comp <> g AND (size IS NULL OR size < gn OR (size = gn AND g < comp))").select("g", "gn", "id", "body", "comp").distinct()
    ask = scratch.cut(ask, "ask")
    bodies = cand.select("id", "body").distinct()
    one = F.lit(1).alias("kind")
    # Those who ask are dealt over parts, and every part has the members of the block.
    asking = ask.groupBy("g").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(BLOCK * ASKING)).cast("int").alias("parts"))
    asking = scratch.cut(asking, "asking")
    size_of = counts.select(F.col("comp").alias("g"), F.col("n").alias("size")).join(asking.select("g", "parts"), "g")
    asked = scratch.cut(size_of.select(F.col("g").alias("comp"), F.col("size").alias("n"), "parts"), "asked")
    main = hot_join(sized.select("id", "comp"), asked, "comp", comps.count()).join(bodies, "id")
    main = main.select(one, F.col("comp").alias("g"), _dealt("id", _blocks(F.col("n"))).alias("block"), _upto(F.col("parts") - 1).alias("part"), F.lit(0).alias("role"), "id", "body", "comp")
    ask = hot_join(ask, asking, "g", ask.count()).select(one, "g", _upto(_blocks(F.col("gn")) - 1).alias("block"), _dealt("id", F.col("parts")).alias("part"), F.lit(1).alias("role"), "id", "body", "comp")
    # Among the classes of a bucket that no link has met yet: each asks its own block and those above it.
    alone = rest.where("size IS NULL").drop("size")
    sizes = scratch.cut(alone.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "alone")
    alone = hot_join(alone, sizes, "key", rows).withColumn("blocks", _blocks(F.col("n"))).withColumn("own", _dealt("id", F.col("blocks")))
    two, part = F.lit(2).alias("kind"), F.floor(F.col("own") / F.lit(ASKING)).cast("int")
    held = alone.select(two, F.col("key").alias("g"), F.col("own").alias("block"), _upto(part).alias("part"), F.lit(0).alias("role"), "id", "body", "comp")
    asks = alone.select(two, F.col("key").alias("g"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(1).alias("role"), "id", "body", "comp")
    return main.unionByName(ask).unionByName(held).unionByName(asks)


def _id_links(named: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links (u, v) between the classes that hold texts of one id; none if each id has one text."""
    key = F.struct("k1", "k2")
    several = named.groupBy("id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b").select("id")
    several = scratch.cut(several, "several")
    if several.isEmpty():
        return None
    classes = named.select("id", "k1", "k2").distinct().join(_small(several), "id", "left_semi")
    held = scratch.cut(classes.join(reps.select("k1", "k2", F.col("id").alias("rep")), ["k1", "k2"]).select("id", "rep").distinct(), "shared")
    least = scratch.cut(held.groupBy("id").agg(F.count("*").alias("n"), F.min("rep").alias("v")), "least")
    return hot_join(held, least, "id", held.count()).select(F.col("rep").alias("u"), "v").where("u <> v").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and body (a hash of the text) of every row, from its whole text.

    Two texts are linked if 100 * common shingles >= percent * all shingles of both. A component's id is its least
    doc_id. Texts without words (null, empty, blank) are linked with nothing. A row without doc_id stands alone: its
    component_id is null and kept is false. Rows that share a doc_id are one document: they and all that is linked with
    any of them are one component, and each gets its own n_shingles. Very long texts need no more than their set; an
    empty table gives no rows; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    sig = scratch.cut(signatures(docs, size), "signatures")
    named = sig.where("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("id", "body", "sig")).alias("r"), F.count("*").alias("rows"))
    reps = scratch.cut(classes.select("k1", "k2", "rows", "r.*"), "classes")
    cand = scratch.cut(_candidates(reps, scratch), "buckets")
    stars = scratch.cut(_star_places(cand, scratch), "stars")
    links = block_links(docs, stars, size, percent, one_each=False)
    shared = _id_links(named, reps, scratch)
    comps = scratch.cut(components(links if shared is None else links.unionByName(shared).distinct(), scratch), "components")
    rest = scratch.cut(_rest_places(cand, comps, scratch), "places")
    more = scratch.cut(block_links(docs, rest, size, percent, one_each=True), "links")
    if not more.isEmpty():
        own = comps.select(F.col("id").alias("u"), F.col("comp").alias("cu"))
        lifted = more.join(own, "u", "left").join(comps.select(F.col("id").alias("v"), F.col("comp").alias("cv")), "v", "left")
        lifted = lifted.select(F.coalesce("cu", "u").alias("a"), F.coalesce("cv", "v").alias("b")).where("a <> b")
        lifted = lifted.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        upper = components(lifted, scratch).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        below = comps.join(upper, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
        alone = upper.select(F.col("comp").alias("id"), F.col("top").alias("comp")).join(comps.select("id"), "id", "left_anti")
        comps = scratch.cut(below.unionByName(alone), "joined")
    placed = reps.select("k1", "k2", "rows", "id").join(comps, "id", "left").where("rows > 1 OR comp IS NOT NULL")
    placed = placed.select("k1", "k2", F.coalesce("comp", "id").alias("comp"))
    found = sig.select("id", "body", "n", "k1", "k2").join(placed, ["k1", "k2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"), "body")


def deduplicate(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of *docs*, all columns, of which one for each component stays: that of the least doc_id.

    Rows without doc_id stay; of several rows with one doc_id that stays, one does. Columns of *docs* may have any names.
    """
    scratch = Scratch(docs.sparkSession)
    (key,) = unused(docs, "near_id")
    found = scratch.cut(near_duplicates(docs, size, percent).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(key), F.col("kept").alias(f"{key}_kept")), "kept")
    gone = found.where(f"NOT {key}_kept").select(key).distinct()
    same = F.col("doc_id").cast("long") == F.col(key)
    left = docs.join(_small(gone), same, "left_anti")
    twice = scratch.cut(found.where(f"{key}_kept").groupBy(key).count().where("count > 1").select(key), "twice")
    if twice.isEmpty():
        return left
    return left.join(_small(twice), same, "left_anti").unionByName(left.join(_small(twice), same, "left_semi").dropDuplicates(["doc_id"]))


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80).drop("body")


QUERIES = {"op10_minhash_near_duplicates": op10_minhash_near_duplicates}
