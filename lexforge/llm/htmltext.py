"""Operator 5: main text of web pages by text-to-tag ratio.

The standard library's parser streams its events; they are folded into lines, one for each block of text, with the
characters and tags of each. The text-to-tag ratios of the lines are smoothed with a Gaussian kernel, and two
clusters are split by a threshold between their means. The regions (articles, sections, other containers)
that hold lines of the upper cluster are the content, each with all of its lines and with what lies between two of
them, so that a short paragraph between long ones stays. What the page's own markup sets apart (menus, headers,
footers, sidebars, notices, adverts, forms, comments) takes part in the ratios but is never content, unless a block
that only its class sets apart is never closed: then it says nothing of what follows, and the ratios decide. Where a
region that the page marks as its article is among the content, unmarked ones beside it are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, map_columns
from lexforge.session import table

#: Width of the Gaussian kernel, in lines.
SIGMA = 1.0

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) - {"br"}
_RAW = frozenset("script style noscript template svg math head title iframe object canvas audio video".split())
_APART = frozenset("nav header footer aside form button select textarea dialog menu label fieldset".split())
_MAIN = frozenset("article main".split())
_REGIONS = _MAIN | _APART | frozenset("body section div center".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of a class or id that set a block apart, if all other words of that class only say what shape or place it has.
_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
_WORDS = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr "
    "header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related "
    "share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget".split()
)
_SHAPES = frozenset(
    "a and area bar block bottom box btn button buttons card column container content float form global group icons id inline "
    "inner item items js layout left legal links list main module nav outer page panel primary region right rail row "
    "secondary section site slot space sticky the thread to top unit us user view wrap wrapper".split()
)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that end where the next one begins or their container ends.
_IMPLICIT = frozenset("p li tr td th dt dd option tbody thead tfoot".split())
#: How far an element is set apart: not, by a class that may be left open, or for good.
OPEN, SOFT, HARD = 0, 1, 2


def _named_apart(value: str) -> int:
    """What the classes of an element say of it."""
    level = OPEN
    for name in value.split():
        parts = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
        if parts and _WORDS.intersection(parts) and all(w in _WORDS or w in _SHAPES for w in parts):
            level = max(level, HARD if _COMMENTS.intersection(parts) else SOFT)
    return level


def set_apart(tag: str, attrs: list[tuple[str, str | None]], in_article: bool = False) -> int:
    """Whether an element's name, role, class or id says that it is not of the article, whose own header is."""
    if tag == "header" and in_article:
        return OPEN
    if tag in _APART:
        return HARD
    if tag in ("html", "body", "main"):
        return OPEN
    level = OPEN
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return HARD
            continue
        if name == "role" and value.strip().lower() in _ROLES or name == "aria-hidden" and value.strip().lower() == "true":
            return HARD
        if name in ("class", "id"):
            found = _named_apart(value)
            level = max(level, found if tag != "article" or found == HARD else OPEN)
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return HARD
    return level


class Blocks(HTMLParser):
    """Folds parser events into lines: (text, tags seen since the last line, region, inside the marked article, set apart
    for good, the elements around it that a class sets apart)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, bool, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.open: list[tuple[str, int, bool, int]] = []  # of block elements: name, how far apart, article, number
        self.raw = self.hard = self.main = self.regions = self.number = 0
        self.soft: list[int] = []
        self.unclosed: set[int] = set()
        self.region = [0]

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are of no use here

    def line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.lines.append((text, self.tags, self.region[-1], self.main > 0, self.hard > 0, tuple(self.soft)))
                self.tags = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in _INLINE:
            if attrs and set_apart(tag, attrs):
                self._push(tag, attrs, HARD)
            return
        self.line()
        if tag in _VOID:
            return
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):  # one ends where the next begins
            if self.open and self.open[-1][0] == tag:
                self._pop(len(self.open) - 1)
            if tag == "p":
                self.open.append((tag, OPEN, False, 0)) if not attrs else self._push(tag, attrs)
                return
        self._push(tag, attrs)

    def _push(self, tag: str, attrs: list, level: int | None = None) -> None:
        if level is None:
            level = HARD if tag in _RAW else set_apart(tag, attrs, self.main > 0)
        main = tag in _MAIN and level == OPEN
        self.number += 1
        self.open.append((tag, level, main, self.number))
        self.raw += tag in _RAW
        self.hard += level == HARD
        self.main += main
        if level == SOFT:
            self.soft.append(self.number)
        if tag in _REGIONS:
            self.regions += 1
            self.region.append(self.region[-1] if self.main > main else self.regions)  # an article is one region

    def _pop(self, at: int, own: bool = True) -> None:
        """Close the elements from *at* on: that one by its *own* end tag, the others because they lie in it."""
        for i, (tag, level, main, number) in enumerate(self.open[at:]):
            self.raw -= tag in _RAW
            self.hard -= level == HARD
            self.main -= main
            if level == SOFT:
                self.soft.remove(number)
                if not (own and i == 0) and tag not in _IMPLICIT:
                    self.unclosed.add(number)
            if tag in _REGIONS:
                self.region.pop()
        del self.open[at:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _INLINE:
            if self.open and self.open[-1][0] == tag:
                self._pop(len(self.open) - 1)
            return
        self.line()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if tag == "p" and self.open[at][2]:
                return

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.parts.append(data)

    def finish(self) -> None:
        self.close()
        self.line()
        self._pop(0, own=False)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at both ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    over = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[over] / np.convolve(np.ones(len(values)), kernel)[over]


def threshold(values: np.ndarray) -> float:
    """Split of two clusters: the point half-way between their means, iterated until it stands still."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of one page; empty where there is none."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([len(text) / max(1, tags) for text, tags, *_ in lines], dtype=float)
    smoothed = smooth(np.log1p(ratio), sigma)
    upper = smoothed > threshold(smoothed)
    away = [hard or not parser.unclosed.issuperset(soft) for *_, hard, soft in lines]
    own = [line for line, out in zip(lines, away, strict=True) if not out]
    chosen = {line[2]: line[3] for line, high, out in zip(lines, upper, away, strict=True) if high and not out}
    if not chosen:  # all lines alike, or the dense ones are set apart: nothing tells the others from one another
        chosen = {line[2]: line[3] for line in own}
    if any(chosen.values()):
        return " ".join(line[0] for line in own if line[3] and line[2] in chosen)
    places = [i for i, line in enumerate(own) if line[2] in chosen]
    return " ".join(line[0] for line in own[places[0] : places[-1] + 1]) if places else ""


def extract(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, from its whole html, however long.

    A null or empty html, or one without text, gives an empty text; null and repeated ids and urls and repeated rows
    are kept row by row; an empty table gives no rows; other columns are ignored whatever their names. Each row is
    handled alone, so there is no shuffle.
    """

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for batch in batches:
            text = [main_text(h, sigma) for h in batch["html"]]
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": list(map(len, text))}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return map_columns(rows, run, "page_id long, url string, text string, n_chars long")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op5_main_text": op5_main_text}
