"""Normalised texts with the way back to the raw one.

A normalising step replaces short spans of a text. Where it does, the distance between the two texts changes: these
break points are kept as two sorted arrays (place in the new text, place in the raw one). Between break points both
texts run in parallel, so a place is found by the last break point before it, and two steps are composed by moving the
first step's break points through the second.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.session import ship

Step = tuple[str, list[int], list[int]]

#: A letter with the marks behind it, or a Hangul syllable in parts.
_CLUSTER = re.compile("[ᄀ-ᅟ][ᅠ-ᇿ]+|[^\\s̀-ͯ][̀-ͯ]+")
_SPACES = " \t  "
_RUN = re.compile(f"[{_SPACES}]{{2,}}")
# The beginnings of file numbers that may be written with spaces around the slash.
_SLASH = re.compile(rf"(?:\d[A-Z]{{1,2}}[ _.]|[A-Z]{{1,2}}-)\d{{1,5}}([{_SPACES}]*/[{_SPACES}]*)\d{{4}}(?!\d)")


def edited(text: str, edits: list[tuple[int, int, str]]) -> Step:
    """The text with each (start, end, replacement), in order, and the break points behind them."""
    out, at, raw, done, size = [], [], [], 0, 0
    for start, end, new in edits:
        out += [text[done:start], new]
        size += start - done + len(new)
        at.append(size)
        raw.append(end)
        done = end
    out.append(text[done:])
    return "".join(out), at, raw


def composed(text: str) -> Step:
    """Canonical composition. Clusters are composed one by one; a word for which that is not enough, as a whole."""
    if unicodedata.is_normalized("NFC", text):
        return text, [], []
    edits = []
    for word in re.finditer(r"\S+", text):
        whole = unicodedata.normalize("NFC", word[0])
        if whole == word[0]:
            continue
        parts = [(m.start(), m.end(), unicodedata.normalize("NFC", m[0])) for m in _CLUSTER.finditer(word[0])]
        parts = [p for p in parts if p[2] != word[0][p[0] : p[1]]]
        if edited(word[0], parts)[0] != whole:
            parts = [(0, len(word[0]), whole)]
        edits += [(word.start() + a, word.start() + b, new) for a, b, new in parts]
    return edited(text, edits)


def collapsed(text: str) -> Step:
    """Runs of spaces as their first one."""
    return edited(text, [(m.start() + 1, m.end(), "") for m in _RUN.finditer(text)])


def unspaced(text: str) -> Step:
    """File numbers without spaces around the slash."""
    return edited(text, [(*m.span(1), "/") for m in _SLASH.finditer(text) if m[1] != "/"])


def place(at: list[int], raw: list[int], places) -> np.ndarray:
    """Raw places of places in the new text."""
    at, raw, places = np.array([0, *at], np.int64), np.array([0, *raw], np.int64), np.asarray(places, np.int64)
    k = np.searchsorted(at, places, "right") - 1
    return raw[k] + places - at[k]


def then(first: Step, second: Step) -> Step:
    """Break points of two steps in a row: those of the second in raw places, and those of the first that still show."""
    text, at2, mid2 = second
    at = np.array([0, *at2], np.int64)
    mid = np.array([0, *mid2], np.int64)
    at1 = np.array(first[1], np.int64)
    k = np.searchsorted(mid, at1, "right") - 1
    moved = at[k] + at1 - mid[k]
    kept = moved <= np.append(at, np.iinfo(np.int64).max)[k + 1]
    found = dict(zip(moved[kept].tolist(), np.array(first[2], np.int64)[kept].tolist(), strict=True))
    found |= dict(zip(at2, place(first[1], first[2], mid2).tolist(), strict=True))
    order = sorted(found)
    return text, order, [found[a] for a in order]


def normalised_text(text: str) -> Step:
    """Composition, then single spaces, then slashes, with break points into the raw text."""
    step: Step = (text, [], [])
    for make in (composed, collapsed, unspaced):
        made = make(step[0])
        if made[1]:  # most texts need none of the steps, and few more than one
            step = then(step, made) if step[1] else made
    return step


def with_places(docs: DataFrame, text: str = "text") -> DataFrame:
    """*docs* with ``plain``: struct(text, at, raw). A null text is an empty one."""
    ship(docs.sparkSession)

    @F.pandas_udf("struct<text:string,at:array<int>,raw:array<int>>")
    def plain(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normalised_text(t or "") for t in texts], columns=["text", "at", "raw"])

    return docs.withColumn("plain", plain(F.col(text)))


def raw_places(plain: Column, places: Column) -> Column:
    """Raw places (array) of an array of places in ``plain``'s text; as they are where nothing was changed."""

    @F.pandas_udf("array<int>")
    def found(at: pd.Series, raw: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([place(a, r, p).astype(np.int32) for a, r, p in zip(at, raw, asked, strict=True)])

    return F.when(F.size(plain["at"]) == 0, places.cast("array<int>")).otherwise(found(plain["at"], plain["raw"], places.cast("array<int>")))


def laid(plain: Column, sizes: Column, widths: Column) -> Column:
    """Raw struct(start, end) of each of a text's pieces: *sizes* are those of the pieces that ``plain``'s text consists of, in order, *widths* what counts of them."""

    @F.pandas_udf("struct<start:array<int>,end:array<int>>")
    def found(at: pd.Series, raw: pd.Series, sizes: pd.Series, widths: pd.Series) -> pd.DataFrame:
        rows = []
        for a, r, s, w in zip(at, raw, sizes, widths, strict=True):
            start = np.cumsum(s) - s
            ends = (start, start + w)
            rows.append([(place(a, r, x) if len(a) else x).astype(np.int32) for x in ends])
        return pd.DataFrame(rows, columns=["start", "end"])

    at = found(plain["at"], plain["raw"], sizes.cast("array<int>"), widths.cast("array<int>"))
    return F.arrays_zip(at["start"].alias("start"), at["end"].alias("end"))


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """id, start, end, letters of spans (id, start, end) of the raw texts (id, text), each text read once."""
    ship(docs.sparkSession)
    listed = spans.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    @F.pandas_udf("array<string>")
    def letters(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([[(t or "")[s["start"] : s["end"]] for s in spans] for t, spans in zip(texts, asked, strict=True)])

    # Texts are dealt out whatever their files' size promises: they are never sent to all.
    met = docs.select("id", "text").join(listed.hint("merge"), "id").select("id", F.explode(F.arrays_zip("spans", letters("text", "spans").alias("letters"))).alias("x"))
    return met.select("id", "x.spans.start", "x.spans.end", "x.letters")
