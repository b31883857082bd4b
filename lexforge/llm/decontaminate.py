"""Operator 8: benchmark decontamination with an FM-index per training shard.

Each task cuts its rows into shards of bounded size and builds an FM-index of each: the Burrows-Wheeler transform of
the shard's words, a wavelet matrix that answers rank queries on it, and a sample of suffix positions. All windows of
the benchmark are searched backward in the index at once; the occurrences are located by walking to the nearest
sampled position, and overlapping ones are merged into removal spans. Words outside the benchmark cannot take part in
an occurrence, so they are left out of the index along with runs too short for any window; nothing is lost by it.

A large benchmark is searched in parts of bounded size. Each part is a job of its own, of which only the spans of texts
that are hit are written, under the texts' digests; so neither the driver nor a task ever holds more than a part. The
spans of all parts are then united by text and meet the rows once.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import HOT_ROWS, HOT_SHARE, Columns, bounded_batches, map_columns, unused
from lexforge.session import Scratch, table

#: Consecutive words of a window; an item of fewer is one window.
WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Words of a shard, and the distance of sampled suffix positions.
SHARD_WORDS, SAMPLE = 1 << 21, 8
#: A part of the benchmark that is sent to the tasks at once has about so many bytes of text.
PART_BYTES = 4 << 20
#: Spans of so many texts and hits at most are broadcast; beyond that only those of texts with very many rows are.
SENT_TEXTS = 100_000

_KEEP = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z in lower case, bytes that are not of words as spaces.
_TABLE = bytes(c if c in _KEEP else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WaveletMatrix:
    """Rank queries over a sequence of small integers, for many (symbol, position) pairs at a time."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            high = (values >> bit) & 1
            total = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(high, out=total[1:])
            self.ones.append(total)
            self.zeros.append(len(values) - int(total[-1]))
            values = np.concatenate([values[high == 0], values[high == 1]])

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start = np.zeros(len(positions), dtype=np.int64)
        at = positions.astype(np.int64)
        for level in range(self.bits):
            high = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            first, last = ones[start], ones[at]
            start = np.where(high, zeros + first, start - first)
            at = np.where(high, zeros + last, at - last)
        return at - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. Zeros end runs; each is smaller than all else and than the zeros after it."""
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    size, step = len(text), 1
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.empty(size, dtype=np.int64)
        sorted_rank = rank[order]
        fresh = np.empty(size, dtype=np.int64)
        fresh[0] = 0
        np.cumsum(sorted_rank[1:] != sorted_rank[:-1], out=fresh[1:])
        new[order] = fresh
        if fresh[-1] == size - 1:
            return order
        rank = new * (size + 1)
        rank[: size - step] += new[step:] + 1
        order = np.argsort(rank, kind="stable")
        step *= 2


class FMIndex:
    """Full-text index of runs of symbols (from 1) that are each closed by a zero."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(text.max()).bit_length()))
        starts = np.zeros(len(text), dtype=bool)
        starts[0] = True
        starts[1:] = text[:-1] == 0
        taken = (order % sample == 0) | starts[order]  # a walk never has to cross a zero
        self.sampled = np.full(len(text), -1, dtype=np.int64)
        self.sampled[taken] = order[taken]
        self.largest = int(text.max())

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (all of one length)."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), len(self.bwt), dtype=np.int64)
        alive = np.flatnonzero((patterns <= self.largest).all(axis=1))
        high[(patterns > self.largest).any(axis=1)] = 0
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, column]
            low[alive] = self.before[symbols] + self.wavelet.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.wavelet.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        found, at, steps, left = np.empty(len(rows), dtype=np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(left):
            known = self.sampled[at] >= 0
            found[left[known]] = self.sampled[at[known]] + steps
            left, at = left[~known], at[~known]
            symbols = self.bwt[at]
            at = self.before[symbols] + self.wavelet.rank(symbols, at)
            steps += 1
        return found


@dataclass
class Phrases:
    """Distinct windows of a part of the benchmark as symbols, with the items that hold each."""

    vocabulary: dict[bytes, int]
    windows: dict[int, np.ndarray]  # by length
    holders: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: where a window's items begin in a list of items
    names: list[str]

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)

    def items(self, size: int, window: int) -> list[str]:
        first, listed = self.holders[size]
        return [self.names[i] for i in listed[first[window] : first[window + 1]].tolist()]

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            symbols = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], dtype=np.int32)
            if item is not None and len(symbols):
                rows = np.lib.stride_tricks.sliding_window_view(symbols, min(window, len(symbols)))
                owner = np.full(len(rows), names.setdefault(str(item), len(names)), dtype=np.int32)
                found.setdefault(rows.shape[1], []).append((rows, owner))
        windows, holders = {}, {}
        for size, parts in found.items():
            rows, owners = (np.concatenate(p) for p in zip(*parts, strict=True))
            windows[size], which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.column_stack([which.ravel(), owners]), axis=0)
            holders[size] = (np.searchsorted(pairs[:, 0], np.arange(len(windows[size]) + 1)), pairs[:, 1])
        return cls(vocabulary, windows, holders, list(names))


def search_shard(lists: list[list[bytes]], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """For each document of a shard: its merged spans of hit words, and the items that occur in it."""
    spans: list[list[tuple[int, int]]] = [[] for _ in lists]
    items: list[set[str]] = [set() for _ in lists]
    sizes = np.array([len(ws) + 1 for ws in lists], dtype=np.int64)
    if not phrases.windows or not len(sizes):
        return spans, items
    symbols = np.zeros(int(sizes.sum()), dtype=np.int32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    get = phrases.vocabulary.get
    for at, ws in zip(starts.tolist(), lists, strict=True):
        if ws:
            symbols[at : at + len(ws)] = np.fromiter(map(get, ws, repeat(0)), dtype=np.int32, count=len(ws))
    known = np.diff(np.concatenate([[0], (symbols > 0).astype(np.int8), [0]]))
    first, last = np.flatnonzero(known == 1), np.flatnonzero(known == -1)
    long = last - first >= phrases.shortest
    first, last = first[long], last[long]
    if not len(first):
        return spans, items
    # Runs side by side, each with the zero that closes it (every run is followed by one).
    length = last - first + 1
    base = np.concatenate([[0], np.cumsum(length)[:-1]])
    origin = np.repeat(first - base, length) + np.arange(int(length.sum()))
    text = symbols[origin]
    text[np.cumsum(length) - 1] = 0
    index = FMIndex(text)
    cover = np.zeros(len(symbols) + 1, dtype=np.int32)
    for size, windows in phrases.windows.items():
        low, high = index.search(windows)
        count = high - low
        total = int(count.sum())
        if not total:
            continue
        which = np.repeat(np.arange(len(windows)), count)
        rows = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        at = origin[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        pairs = np.unique(np.column_stack([np.searchsorted(starts, at, side="right") - 1, which]), axis=0)
        for doc, window in pairs.tolist():
            items[doc].update(phrases.items(size, window))
    edges = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        doc = int(np.searchsorted(starts, a, side="right")) - 1
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    return spans, items


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjoining spans as one, in order."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def _search(lists: list[list[bytes]], phrases: Phrases, window: int, shard_words: int) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """As :func:`search_shard`; a document longer than a shard is searched in pieces that overlap by a window less a word."""
    if len(lists) > 1 or not lists or len(lists[0]) <= shard_words + window:
        return search_shard(lists, phrases)
    spans, items = [], set()
    for start in range(0, len(lists[0]), shard_words):
        (found,), (who,) = search_shard([lists[0][start : start + shard_words + window - 1]], phrases)
        spans += [(a + start, b + start) for a, b in found]
        items |= who
    return [_union(spans)], [items]


def _places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code points of the text."""
    if not spans:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in _WORD.finditer(raw)]
    # Code points before each byte: bytes that do not continue a character.
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(before[words[a][0]]), int(before[words[b - 1][1]])) for a, b in spans]


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items, in parts of about *part_bytes* of text by a hash of the id; only one is held at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & (F.octet_length("text") > 0)).select("item_id", "text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-size // part_bytes))
    for part in range(count):
        yield [(r[0], r[1]) for r in (rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == part) if count > 1 else rows).collect()]


_SPANS = "array<struct<start:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, shard_words: int = SHARD_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, spans (code points, merged) and contaminated of every row's whole text.

    A null or empty text has no words and is clean; so is all if the benchmark is empty. Items without an id are
    ignored, items with equal ids are one. Repeated rows and ids are judged row by row, null ids stay null, texts longer
    than a shard are searched in overlapping pieces, and other columns are ignored whatever their names. No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = list(itertools.islice(benchmark_parts(benchmark, part_bytes), 2))
    if len(parts) > 1:
        keyed = rows.withColumn("digest", F.md5("text"))
        rows = _met(keyed, _hits_by_text(keyed, benchmark, window, shard_words, part_bytes), "digest").drop("digest")
        phrases = Phrases.of([], window)
    else:
        rows = rows.select("*", F.array().cast("array<string>").alias("item_ids"), F.array().cast(_SPANS).alias("hits"))
        phrases = Phrases.of(parts[0], window)
    found = map_columns(rows, _pass(phrases, window, shard_words, last=True), f"doc_id long, n_words long, n_hit long, item_ids array<string>, spans {_SPANS}")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _hits_by_text(rows: DataFrame, benchmark: DataFrame, window: int, shard_words: int, part_bytes: int) -> DataFrame:
    """digest, n (rows), item_ids and hits (word spans) of all texts of *rows* (text, digest) that some part of the benchmark hits."""
    scratch, tables = Scratch(rows.sparkSession), []
    plain = rows.select("text", "digest", F.array().cast("array<string>").alias("item_ids"), F.array().cast(_SPANS).alias("hits"))
    for items in benchmark_parts(benchmark, part_bytes):
        found = map_columns(plain, _pass(Phrases.of(items, window), window, shard_words, last=False), f"digest string, item_ids array<string>, hits {_SPANS}")
        # Equal texts have equal hits; copies are one row for each task before they meet.
        once = found.groupBy("digest").agg(F.count("*").alias("n"), F.first("item_ids").alias("item_ids"), F.first("hits").alias("hits"))
        tables.append(scratch.cut(once, "part"))
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    # One row for each part at most.
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("item_ids", "hits")]
    return scratch.cut(every.groupBy("digest").agg(F.max("n").alias("n"), *lists), "hits")


def _met(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """*rows* with item_ids and hits of their texts, empty where there are none; rows of hot texts stay where they are."""
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("hits") + F.size("item_ids")), F.lit(0)).alias("hits")).first()
    often = found if size["n"] + size["hits"] <= SENT_TEXTS else found.where(F.col("n") > max(HOT_ROWS, int(rows.count() * HOT_SHARE)))
    out = rows.join(F.broadcast(often.drop("n")), key, "left")
    if often is not found:
        rest = found.join(F.broadcast(often.select(key)), key, "left_anti").select(key, F.col("item_ids").alias("more_ids"), F.col("hits").alias("more_hits"))
        # Rows that have their hits already ask under keys that no text has, each its own.
        asking = F.when(F.col("hits").isNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
        out = out.withColumn("asking", asking).join(rest.withColumnRenamed(key, "asking"), "asking", "left")
        out = out.withColumn("item_ids", F.coalesce("item_ids", "more_ids")).withColumn("hits", F.coalesce("hits", "more_hits")).drop("asking", "more_ids", "more_hits")
    none = F.array().cast("array<string>"), F.array().cast(_SPANS)
    return out.withColumn("item_ids", F.coalesce("item_ids", none[0])).withColumn("hits", F.coalesce("hits", none[1]))


def _pass(phrases: Phrases, window: int, shard_words: int, last: bool):
    """A pass over rows that adds the item_ids and hits (word spans) of *phrases* to those they have.

    The last one gives the number of words and of words hit, and the spans as code points, of every row; another one
    gives what it found under the texts' digests, of texts that are hit only.
    """

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        held: list[tuple] = []
        lists: list[list[bytes]] = []
        size = 0
        as_rows = lambda found: [{"start": a, "end": b} for a, b in found]

        def flush() -> Columns:
            spans, items = _search(lists, phrases, window, shard_words) if phrases.windows else ([[] for _ in held], [set() for _ in held])
            if last:
                spans = [_union([*((h["start"], h["end"]) for h in row[3]), *s]) if row[3] else s for row, s in zip(held, spans, strict=True)]
                out: Columns = {"doc_id": [row[0] for row in held], "item_ids": [sorted({*row[2], *i}) for row, i in zip(held, items, strict=True)]}
                out |= {"n_words": list(map(len, lists)), "n_hit": [sum(b - a for a, b in s) for s in spans]}
                out["spans"] = [as_rows(_places(row[1], s)) for row, s in zip(held, spans, strict=True)]
            else:
                hit = [k for k, s in enumerate(spans) if s]
                out = {"digest": [held[k][0] for k in hit], "item_ids": [sorted(items[k]) for k in hit], "hits": [as_rows(spans[k]) for k in hit]}
            held.clear(), lists.clear()
            return out

        name = "doc_id" if last else "digest"
        for b in batches:
            for row in zip(b[name], b["text"], b["item_ids"], b["hits"], strict=True):
                words = words_of(row[1])
                if lists and size + len(words) > shard_words:
                    yield flush()
                    size = 0
                held.append(row), lists.append(words)
                size += len(words)
        yield flush()

    return run


def _shares(share: int):
    """Whether the hits (word spans, unordered) of a text make it contaminated."""

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            hit = [sum(z - a for a, z in _union([(h["start"], h["end"]) for h in hits])) for hits in b["hits"]]
            yield {"digest": b["digest"], "gone": [n * share >= len(words_of(t)) for n, t in zip(hit, b["text"], strict=True)]}

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of *docs* that are not contaminated, all columns.

    With a benchmark of one part each batch of rows is a shard and only texts reach Python. With several parts the texts
    that are hit are judged once each, by the hits of all parts together.
    """
    parts = list(itertools.islice(benchmark_parts(benchmark, part_bytes), 2))
    if len(parts) > 1:
        (digest,) = unused(docs, "__digest")
        keyed = docs.withColumn(digest, F.md5("text"))
        texts = keyed.where("text IS NOT NULL").select("text", F.col(digest).alias("digest"))
        hits = _hits_by_text(texts, benchmark, window, SHARD_WORDS, part_bytes)
        # Only texts that are hit need their words counted, each once.
        asked = texts.join(hits.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")).join(hits, "digest")
        judged = map_columns(asked.select("digest", "text", "hits"), _shares(share), "digest string, gone boolean").where("gone")
        gone = Scratch(docs.sparkSession).cut(judged.select(F.col("digest").alias(digest)), "contaminated")
        return keyed.join(gone, digest, "left_anti").drop(digest)
    phrases = Phrases.of(parts[0], window)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def contaminated(texts: pd.Series) -> pd.Series:
        lists = [words_of(t) for t in texts]
        hits = [sum(b - a for a, b in s) for s in search_shard(lists, phrases)[0]]
        return pd.Series([n > 0 and n * share >= len(ws) for n, ws in zip(hits, lists, strict=True)], dtype=bool)

    return docs.where(~contaminated(F.coalesce(F.col("text"), F.lit(""))))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op8_decontaminate": op8_decontaminate}
