"""Operator 1: document quality by co-training.

Two classifiers see disjoint views of a document: its text (shares of character classes, repetition, word and line
shapes; which words they are is left out, so that clean texts with words of their own are not rejected for them) and its
metadata (source, language, declared length). Both start from the labelled rows; over several rounds each one labels the unlabelled rows it is surest of and hands them to the
other; rows on which the two disagree are handed to neither. The views are then calibrated on labelled rows that
neither was fitted on, and combined under the assumption that co-training makes, that views are independent given the
label: their calibrated log odds add up, less the log odds that both start from. All documents are scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, bounded_batches, map_columns
from lexforge.session import Scratch, table

#: Labelled rows that the classifiers are fitted on, at most (those with the smallest hash of their id), and unlabelled
#: rows that count for the number handed over; the surest are taken from all of them.
FIT_ROWS, POOL_ROWS = 10_000, 10_000
#: Rounds of co-training, the share of POOL_ROWS (or of all, if fewer) that a view hands over in each, and how sure it must be.
ROUNDS, HAND_OVER, SURE = 5, 0.05, 0.9
#: One labelled row in so many is kept for calibration.
CALIBRATION = 4
#: Documents with a lower score are rejected.
KEEP = 0.3

META_BUCKETS = 64
TEXT_FEATURES = 19

_CLASSES = np.zeros((256, 8))
for _i in range(256):
    _c = chr(_i)
    _CLASSES[_i, 0 if 0x61 <= _i <= 0x7A else 1 if 0x41 <= _i <= 0x5A else 2 if 0x30 <= _i <= 0x39 else 3 if _i >= 0x80 else 4 if _c in " \n\t\r" else 5 if _c in ".,;:'\"()-?" else 6 if _c in "|<>{}[]=_/\\" else 7] = 1


def text_view(text: str) -> list[float]:
    """Features of the text's content; those of an empty text are zero."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    words = text.split()
    if not words:
        return [0.0] * TEXT_FEATURES
    shares = np.bincount(raw, minlength=256) @ _CLASSES / len(raw)
    lines = [line for line in text.split("\n") if line]
    counts = Counter(words)
    n = len(words)
    solid = len("".join(words))
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        *shares.tolist(),
        math.log1p(n),
        solid / n / 10,
        len(counts) / math.sqrt(n) / 10,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(solid / max(1, len(lines))) / 10,
        text.count("\n") / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
    ]



def meta_view(source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """Features of what is known about the document beside its text."""
    known = n_chars is not None and n_chars == n_chars and n_chars >= 0
    size = math.log1p(n_chars) if known else 0.0
    row = [0.0] * META_BUCKETS
    row[zlib.crc32(f"source={source}".encode()) % META_BUCKETS] += 1.0
    row[zlib.crc32(f"lang={lang}".encode()) % META_BUCKETS] += 1.0
    return [*row, size / 10, (size / 10) ** 2, float(not known)]


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, 1.0)
        a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        penalty = np.full(a.shape[1], ridge)
        penalty[-1] = 1e-6
        w = np.zeros(a.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(w, mean, scale)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class CoTrained:
    """Both views, their calibration and the log odds of good quality; without labels of both kinds all scores are 0.5."""

    views: tuple[Logistic, Logistic] | None
    calibration: tuple[Logistic, Logistic] | None = None
    prior: float = 0.0
    rounds: tuple[int, ...] = ()

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by the text, by the metadata, and by both."""
        if self.views is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        logits = [c.logit(v.logit(x)[:, None]) for v, c, x in zip(self.views, self.calibration, (text, meta), strict=True)]
        both = np.clip(sum(logits) - self.prior, -30, 30)
        return tuple(1 / (1 + np.exp(-v)) for v in (*logits, both))


def co_train(labelled: list[tuple[list[float], list[float], int]], surest: Callable[[list[Logistic], float], list[tuple]]) -> CoTrained:
    """Fit on (text view, metadata view, label) rows and on what *surest* takes from the unlabelled rows (see :class:`Pool`)."""
    y = np.array([r[2] for r in labelled], dtype=float)
    held = np.arange(len(y)) % CALIBRATION == CALIBRATION - 1
    fitted = ~held
    if any(len(set(y[part])) < 2 for part in (held, fitted)):
        return CoTrained(None)
    x = [np.array([r[v] for r in labelled]) for v in (0, 1)]
    train = [(x[v][fitted], y[fitted]) for v in (0, 1)]
    rounds, views = [], [Logistic.fit(*t) for t in train]
    for _ in range(ROUNDS):
        handed = surest(views, float(y[fitted].mean()))
        for v, (*free, labels) in ((1, handed[0]), (0, handed[1])):
            if len(labels):
                train[v] = (np.concatenate([train[v][0], free[v]]), np.concatenate([train[v][1], labels]))
        rounds.append(sum(len(h[2]) for h in handed))
        if not rounds[-1]:
            break
        views = [Logistic.fit(*t) for t in train]
    calibration = [Logistic.fit(views[v].logit(x[v][held])[:, None], y[held]) for v in (0, 1)]
    prior = float(np.log(y[held].mean() / (1 - y[held].mean())))
    return CoTrained(tuple(views), tuple(calibration), prior, tuple(rounds))


_FEATURES = "id long, row long, text_view array<float>, meta_view array<float>"


def _features(batches: Iterator[Columns]) -> Iterator[Columns]:
    for b in batches:
        meta = [meta_view(*r) for r in zip(b["source"], b["lang"], b["n_chars"], strict=True)]
        yield {"id": b["id"], "row": b["row"], "text_view": list(map(text_view, b["text"])), "meta_view": meta}


class Pool:
    """All unlabelled rows. Their features are written once; in every round each task scores its own and keeps the surest."""

    def __init__(self, features: DataFrame, scratch: Scratch, pool_rows: int):
        self.features, self.scratch = features, scratch
        self.most = max(1, int(HAND_OVER * min(features.count(), pool_rows)))
        self.gone: set[int] = set()  # rows handed over; equal rows go together

    def surest(self, views: list[Logistic], share: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each view the (text view, metadata view, label) of the waiting rows that it is surest of."""
        # As many of either label as its share among the labelled rows allows, the surest first.
        limits = {1: int(self.most * share), 0: math.ceil(self.most * (1 - share))}
        gone = self.gone

        def run(batches: Iterator[Columns]) -> Iterator[Columns]:
            kept: dict[tuple[int, int], list[tuple]] = {(v, label): [] for v in (0, 1) for label in (1, 0)}
            for b in batches:
                rows = [r for r in zip(b["row"], b["text_view"], b["meta_view"], strict=True) if r[0] not in gone]
                if not rows:
                    continue
                p = [1 / (1 + np.exp(-views[v].logit(np.array([r[v + 1] for r in rows])))) for v in (0, 1)]
                for (v, label), best in kept.items():
                    sure, other = (q if label else 1 - q for q in (p[v], p[1 - v]))
                    # A row of which the other view is sure that it has the other label is nobody's.
                    at = np.flatnonzero((sure >= SURE) & (other > 1 - SURE))
                    best += [(-sure[i], *rows[i]) for i in at.tolist()]
                    best.sort(key=lambda r: r[:2])
                    del best[limits[label] :]
            for (v, label), best in kept.items():
                n = len(best)
                yield {"row": [r[1] for r in best], "text_view": [r[2] for r in best], "meta_view": [r[3] for r in best], "view": [v] * n, "label": [label] * n, "sure": [-r[0] for r in best]}

        schema = "row long, text_view array<float>, meta_view array<float>, view int, label int, sure double"
        top = self.scratch.cut(map_columns(self.features.drop("id"), run, schema), "surest")
        handed = []
        for v in (0, 1):
            # Each task has given limits[label] rows at most, and the sort keeps as many of a partition.
            rows = [r for label in (1, 0) for r in top.where((F.col("view") == v) & (F.col("label") == label)).orderBy(F.desc("sure"), "row").limit(limits[label]).collect()]
            handed.append((np.array([r["text_view"] for r in rows]), np.array([r["meta_view"] for r in rows]), np.array([r["label"] for r in rows], dtype=float)))
            self.gone |= {r["row"] for r in rows}
        self.scratch.drop(top)
        return handed


def _viewed(docs: DataFrame) -> DataFrame:
    columns = {c: F.col(c) if c in docs.columns else F.lit(None) for c in ("source", "lang", "n_chars")}
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), columns["source"].cast("string").alias("source"), columns["lang"].cast("string").alias("lang"), columns["n_chars"].cast("double").alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained:
    """Co-train on a bounded sample of the labelled rows and on all unlabelled ones; only features reach the driver.

    *pool_rows* bounds the number of rows that are handed over, not the rows that they are chosen from. Of several
    labels of one id, or several rows, the least counts, so at most *fit_rows* rows are collected.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.col("quality").cast("int")).alias("label"))
    some = F.broadcast(known.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(fit_rows))  # fit_rows rows at most
    viewed = _viewed(docs).withColumn("row", F.xxhash64("id", "text", "source", "lang", "n_chars"))
    features = scratch.cut(map_columns(viewed, _features, _FEATURES), "features")
    rows = features.join(some, "id").groupBy("id", "label").agg(F.min(F.struct("row", "text_view", "meta_view")).alias("r")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    labelled = [(r["r"]["text_view"], r["r"]["meta_view"], r["label"]) for r in rows]
    rest = scratch.cut(features.join(known.select("id"), "id", "left_anti"), "pool")
    scratch.drop(features)
    model = co_train(labelled, Pool(rest, scratch, pool_rows).surest)
    scratch.drop(rest)
    return model


def score_quality(docs: DataFrame, model: CoTrained, keep: float = KEEP) -> DataFrame:
    """doc_id, text_score, meta_score, score (probability of good quality) and keep of every row, from its whole text.

    Null texts are scored as empty, null or absent metadata as values of their own. Repeated rows and ids are scored row
    by row, equal rows alike; null ids stay null; an empty table gives no rows; columns beyond doc_id, text, source, lang
    and n_chars are ignored whatever their names. Without a model all scores are 0.5 and all rows are kept (the limit is
    below it, so short plain texts stay). No shuffle takes place.
    """

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            if b["id"]:
                text = np.array(list(map(text_view, b["text"])))
                meta = np.array([meta_view(*r) for r in zip(b["source"], b["lang"], b["n_chars"], strict=True)])
                by_text, by_meta, both = model.score(text, meta)
                yield {"doc_id": b["id"], "text_score": by_text, "meta_score": by_meta, "score": both}

    found = map_columns(_viewed(docs), run, "doc_id long, text_score double, meta_score double, score double")
    return found.withColumn("keep", F.col("score") >= keep)


def reject(docs: DataFrame, model: CoTrained, keep: float = KEEP) -> DataFrame:
    """The rows of *docs* that pass, all columns; each row is judged alone, so there is no join."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        if not len(text):
            return pd.Series([], dtype=bool)
        views = np.array([text_view(t) for t in text]), np.array([meta_view(*r) for r in zip(source, lang, n_chars, strict=True)])
        return pd.Series(model.score(*views)[2] >= keep)

    columns = [F.col(c) if c in docs.columns else F.lit(None) for c in ("source", "lang", "n_chars")]
    return docs.where(passes(F.coalesce(F.col("text"), F.lit("")), columns[0].cast("string"), columns[1].cast("string"), columns[2].cast("double")))


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_quality_cotraining": op1_quality_cotraining}
