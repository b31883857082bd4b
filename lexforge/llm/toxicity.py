"""Operator 7: toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Texts are folded first: case, accents-free look-alikes of other scripts, digits and signs that stand for letters.
The lexicon is learnt from labelled training rows: whole words and word beginnings that stand out in toxic rows, each
with its log odds as weight. Phrases that hold a lexicon entry but occur in clean rows only are learnt as exceptions
and cancel the entries inside them. The sum of weights is normalised by length, and a logistic curve fitted on the
same training rows turns the densities into a score between 0 and 1.

Training counts in the tasks: only entries and phrases that pass their limits, and one density a row, reach the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, map_columns
from lexforge.session import Scratch, table

#: The classifier is fitted on this many labelled training rows at most (those with the smallest hash of their id).
FIT_ROWS = 8_000
#: A label counts from this score.
CUT = 0.7
#: A lexicon entry occurs in so many unlike toxic rows (and in a hundredth of them, so there are at most a hundred times as many as a row has) at least, and is so many times as frequent there as in clean rows.
LEAST_ROWS, LEAST_ODDS = 4, 8.0
#: Lengths of word beginnings that may become entries; shorter ones say too little.
PREFIX = range(4, 13)
#: The sum of weights is divided by the root of 1 + words / NORM.
NORM = 100

# Look-alike letters of Greek, Cyrillic and other scripts, and the Latin letters they are read as.
_LOOKALIKES = {
    "а": "a", "α": "a", "ɑ": "a", "в": "b", "β": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ё": "e", "ε": "e", "є": "e",
    "ғ": "f", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "ⅼ": "l",
    "м": "m", "ո": "n", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o", "օ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s",
    "т": "t", "τ": "t", "υ": "u", "ս": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ү": "y", "ᴢ": "z",
}
# Digits and signs written for letters.
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i"}
_INVISIBLE = "­​‌‍⁠﻿"

_FULLWIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
_FOLD = {ord(k): v for k, v in _LOOKALIKES.items()} | {ord(c): None for c in _INVISIBLE} | _FULLWIDTH
_DIGITS = str.maketrans(_SUBSTITUTES)
_SUBSTITUTED = re.compile(f"[{re.escape(''.join(_SUBSTITUTES))}]")
_EDGE = re.compile(r"[!|.,;:?()\"'#%&*]+$")
_WORD = re.compile(r"[^\W\d_]+")


def _unmask(word: str) -> str:
    """A word with substitutes read as letters, if letters are at least half of it; pure numbers are left alone."""
    if not _SUBSTITUTED.search(word):
        return word
    core = _EDGE.sub("", word)
    letters = sum(map(str.isalpha, core))
    return core.translate(_DIGITS) if 0 < len(core) - letters <= letters else word


def fold(text: str) -> str:
    """Lower case with look-alikes, full-width forms and letter-for-digit spellings undone; words between single spaces."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _SUBSTITUTED.search(text):
        text = " ".join(map(_unmask, text.split()))
    return f" {' '.join(_WORD.findall(text))} "


@dataclass
class Lexicon:
    """Entries (word beginnings start with a space, whole words also end with one) and phrases that cancel them."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    slope: float = 1.0
    offset: float = 0.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                self._automaton.add_word(phrase, (len(phrase), None))
            self._automaton.make_automaton()
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def density(self, folded: str) -> tuple[float, int]:
        """Sum of weights over the length norm, and the number of entries; the longest entry of a word counts."""
        if not (self.weights or self.exceptions) or len(folded) < 3:
            return 0.0, 0
        at: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in self.automaton().iter(folded):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif length >= at.get(start, (0, 0.0))[0]:
                at[start] = (length, weight)
        spared.sort()
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        inside = lambda s, e: (i := bisect_right(starts, s)) > 0 and e <= reach[i - 1]
        hits = [w for s, (n, w) in at.items() if not inside(s, s + n - 2)]
        return sum(hits) / math.sqrt(1 + folded.count(" ") / NORM), len(hits)

    def score(self, density: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * density + self.offset))))


def _entries(folded: str) -> set[str]:
    """The word beginnings of a text, and its short words whole."""
    words = set(folded.split())
    return {f" {w[:n]}" for w in words for n in PREFIX if n <= len(w)} | {f" {w} " for w in words if len(w) < PREFIX[0]}


def _pairs(folded: str, weights: dict[str, float]) -> set[str]:
    """The word pairs of a text of which one holds an entry."""
    words, found = folded.split(), set()
    for i, word in enumerate(words):
        if f" {word} " in weights or any(f" {word[:n]}" in weights for n in PREFIX):
            found.update(f" {' '.join(words[a : a + 2])} " for a in (i - 1, i) if a >= 0 and a + 2 <= len(words))
    return found


def _counted(rows: DataFrame, found: Callable[[str], set[str]]) -> DataFrame:
    """key, clean and toxic (numbers of rows) of all that *found* gives for the folded texts; each task counts first."""

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, label in zip(b["folded"], b["toxic"], strict=True):
                counts[label].update(found(text))
        for label, counter in counts.items():
            yield {"key": list(counter), "toxic": [label] * len(counter), "n": list(counter.values())}

    each = map_columns(rows, run, "key string, toxic int, n long")
    sums = [F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0)).alias(name) for label, name in ((0, "clean"), (1, "toxic"))]
    return each.groupBy("key").agg(*sums)


def learn(rows: DataFrame) -> Lexicon:
    """The lexicon of labelled rows (text, toxic: 1 or 0). Without rows of both labels it is empty and scores 0.5.

    Texts that are equal when folded count once for each label; all other rows count.
    """
    scratch = Scratch(rows.sparkSession)
    folding = lambda batches: ({"folded": list(map(fold, b["text"])), "toxic": b["toxic"]} for b in batches)
    plain = rows.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    every = scratch.cut(map_columns(plain, folding, "folded string, toxic int"), "folded")
    texts = scratch.cut(every.dropDuplicates(["folded", "toxic"]), "unlike")
    total = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return Lexicon({})
    least = max(LEAST_ROWS, total[1] / 100)
    often = {r["key"]: r["toxic"] for r in _counted(texts.where("toxic = 1"), _entries).where(F.col("toxic") >= least).collect()}
    clean = {r["key"]: r["clean"] for r in _counted(texts.where("toxic = 0"), lambda text: _entries(text) & often.keys()).collect()}
    ratios = {e: (n + 0.5) / (total[1] + 1) / ((clean.get(e, 0) + 0.5) / (total[0] + 1)) for e, n in often.items()}
    odds = {e: math.log(ratio) for e, ratio in ratios.items() if ratio >= LEAST_ODDS}
    # Of beginnings that stand for the same words the longest is kept; a longer one only where it says more than a shorter.
    same = {e[:-1] for e in odds if often[e] >= 0.95 * often.get(e[:-1], math.inf)}
    odds = {e: w for e, w in odds.items() if e not in same}
    kept = {e: w for e, w in sorted(odds.items()) if not any(odds.get(e[:i], 0) >= 0.8 * w for i in range(PREFIX[0] + 1, len(e)))}
    # Phrases that occur in several clean rows and in no toxic one, copies included.
    spared = _counted(every, lambda text: _pairs(text, kept)).where(f"clean >= {LEAST_ROWS} AND toxic = 0")
    found = Lexicon(kept, frozenset(r["key"] for r in spared.collect()))
    dense = lambda batches: ({"density": [found.density(t)[0] for t in b["folded"]], "toxic": b["toxic"]} for b in batches)
    fitted = sorted(map_columns(every, dense, "density double, toxic int").collect())  # two numbers for each training row
    found.slope, found.offset = _logistic(np.array([r["density"] for r in fitted]), np.array([r["toxic"] for r in fitted], dtype=float))
    return found


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge; classes count alike, so 0.5 is where they balance."""
    scale = max(1e-9, float(np.abs(x).max()))
    a = np.column_stack([x / scale, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 1e-3 * b
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), gradient)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Text and label of at most *most* labelled rows outside the held-out fold, those with the least hash of their id.

    Of several labels or texts of one id the least counts.
    """
    held_in = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    held_in = held_in.where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1).groupBy("id").agg(F.min("toxic").alias("toxic"))
    picked = held_in.orderBy(F.xxhash64(F.col("id"), F.lit(7)), "id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Only the picked ids are broadcast: at most *most* of them.
    return rows.join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits of every row's whole text, however long.

    A null text scores as an empty one. The fold of a null doc_id is false. Repeated rows and ids are scored row by row,
    equal texts alike; an empty table gives no rows; other columns are ignored whatever their names; no shuffle.
    """

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            found = [lexicon.density(fold(t)) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "score": [lexicon.score(d) for d, _ in found], "n_hits": [n for _, n in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = map_columns(rows, run, "doc_id long, score double, n_hits int")
    fold_of = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", fold_of.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_hits")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, learn(training_rows(docs, table(spark, sf_dir, "labels"))))


QUERIES = {"op7_toxicity": op7_toxicity}
