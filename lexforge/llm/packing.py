"""Operator 4: vector bin packing of tokenised documents into training sequences.

A sequence has three limits at once: tokens, segments (pieces of documents) and loss-bearing tokens. A piece is a
vector of those three demands, each as a share of its limit; a sequence is filled by the dot-product heuristic: of
the pieces that fit, take the one whose demand has the largest dot product with the capacity that is left. What
no whole piece fits is filled with a part of the best one, since documents may be cut freely. Each task packs its
own rows in a bounded window, so there is no shuffle and no table of open sequences that grows with the data.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, Recent, map_columns
from lexforge.session import table

#: Limits of a sequence. A document's separator id bears no loss.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 64, 2048
SEPARATOR = 1
#: Pieces that wait in a task; beyond it, sequences are closed.
WINDOW = 512
#: White-space chunks, and words in lower case, whose ids a worker keeps (twice as many at most).
KEPT_CHUNKS, KEPT_WORDS = 400_000, 300_000

#: Letters that lower-case and compose one by one, then one mark: two pretokens without the tokenizer's other rules.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,]?)")
# The rules under which white space separates the words of a text for good, as a tokenizer file states them.
_NORMALIZERS = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _by_words(file: str) -> bool:
    """Whether a tokenizer file states the rules by which texts can be encoded word by word."""
    with open(file, encoding="utf-8") as f:
        rules = json.load(f)
    stated = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (rules.get("normalizer") or {}).get("normalizers", [])]
    steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == _SPLIT and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    return stated == _NORMALIZERS and split and steps[1]["type"] == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")


class WordEncoder:
    """Ids of whole texts by a BPE of the tokenizers library, one white-space chunk at a time where its rules allow it.

    Such a tokenizer drops white space and never joins what it separates, so the ids of a text are those of its
    chunks side by side; texts of any other tokenizer are encoded whole. Ids are little-endian unsigned 32-bit bytes.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.by_words = _by_words(file)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(97, 123), *range(0xDF, 0x100)]) if c != "÷"}
        self.words = Recent(self._word, KEPT_WORDS)
        self.chunks = Recent(self.chunk, KEPT_CHUNKS)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes() if word else b""

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk(self, text: str) -> bytes:
        plain = _PLAIN.fullmatch(text)
        if not plain:
            return self._whole(text)
        word, mark = plain.groups()
        return self.words[word.lower()] + self.words[mark] if mark else self.words[word.lower()]

    def encode(self, text: str) -> bytes:
        if not self.by_words:
            return self._whole(text)
        return b"".join(self.chunks.all(text.replace("\n", " ").split(" ")))


_encoders: dict[str, WordEncoder] = {}


def encoder(file: str) -> WordEncoder:
    if "/" not in file:
        import public_tokenizers

        file = public_tokenizers.path(file)
    if file not in _encoders:
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


class Packer:
    """Packs pieces (key, start, length, loss) of at most *tokens* ids; gives (sequence, pieces) for each sequence.

    A piece's loss-bearing ids come first in it. Of equal scores the piece that waits longest is taken.
    """

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, window: int = WINDOW):
        if min(tokens, segments, loss) < 1:
            raise ValueError("a sequence needs room for a token, a segment and a loss-bearing token")
        self.limits = np.array([tokens, segments, loss], dtype=float)
        self.tokens, self.window, self.sequence = tokens, window, 0
        self.pieces: list[tuple] = []
        self.demand = np.empty((window + 64, 3))

    def _wait(self, piece: tuple) -> None:
        at = len(self.pieces)
        if at == len(self.demand):
            self.demand = np.concatenate([self.demand, np.empty_like(self.demand)])
        self.pieces.append(piece)
        self.demand[at] = piece[2], 1, piece[3]

    def add(self, key, start: int, length: int, loss: int) -> Iterator[tuple]:
        """A document's ids from *start*; the last ``length - loss`` of them bear no loss."""
        most = int(self.limits[2])
        while length:
            part = min(length, self.tokens)
            if min(part, loss) > most:
                part = most  # a limit on loss below that on tokens cuts long documents too
            piece = (key, start, part, min(part, loss))
            start, length, loss = start + part, length - part, loss - min(part, loss)
            if part == self.tokens:  # fills a sequence alone
                yield self._close([piece])
            else:
                self._wait(piece)
        while len(self.pieces) >= self.window:
            yield self._fill()

    def finish(self) -> Iterator[tuple]:
        """What waits: full sequences as long as there is enough, then lengths that are powers of two, without padding."""
        while sum(p[2] for p in self.pieces) >= self.tokens:
            yield self._fill()
        while self.pieces:
            rest = sum(p[2] for p in self.pieces)
            yield self._fill(1 << (rest.bit_length() - 1))

    def _close(self, chosen: list[tuple]) -> tuple[int, list[tuple]]:
        self.sequence += 1
        return self.sequence - 1, chosen

    def _fill(self, size: int | None = None) -> tuple[int, list[tuple]]:
        """Close one sequence of *size* tokens at most, chosen from the waiting pieces."""
        limits = self.limits.copy()
        limits[0] = min(size or self.tokens, self.tokens)
        left, chosen, rest, n = limits.copy(), [], None, len(self.pieces)
        demand, free, scale = self.demand[:n], np.ones(n, dtype=bool), limits * limits
        while left[0] > 0 and left[1] > 0 and len(chosen) < n:
            score = demand @ (left / scale)
            fits = free & (demand[:, 0] <= left[0]) & (demand[:, 2] <= left[2])
            score[~fits] = -1.0
            at = int(score.argmax())
            if score[at] >= 0:
                free[at] = False
                chosen.append(self.pieces[at])
                left -= demand[at]
                continue
            # None fits: a part of the best one closes the gap, unless loss is what is used up.
            score = np.where(free, demand @ (left / scale), -1.0)
            at = int(score.argmax())
            key, start, length, loss = self.pieces[at]
            part = int(min(left[0], length))
            if min(part, loss) > left[2]:
                part = int(left[2])
            if part > 0:
                free[at] = False
                chosen.append((key, start, part, min(part, loss)))
                rest = (key, start + part, length - part, max(0, loss - part))
            break
        keep = np.flatnonzero(free)
        self.pieces = [self.pieces[i] for i in keep.tolist()]
        self.demand[: len(keep)] = self.demand[keep]
        if rest is not None:
            self._wait(rest)
        return self._close(chosen)


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long, loss_tokens long"
_COLUMNS = [c.split(" ")[0] for c in _SCHEMA.split(", ")]


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    tokens: int = MAX_TOKENS,
    segments: int = MAX_SEGMENTS,
    loss: int = MAX_LOSS,
    window: int = WINDOW,
    bears_loss: Column | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens.

    A document's ids are the tokenizer's for its whole text (null: empty), then a separator that bears no loss; an
    empty document is the separator alone. *bears_loss* tells of each row whether its ids are trained on (null: no),
    as a turn of the assistant in instruction data is; without it all are. Very long texts are cut into pieces;
    repeated rows and ids are packed as often as they occur, null ids stay null, an empty table gives no rows, and
    other columns are ignored whatever their names. sequence_id holds the task's partition in its upper 31 bits, so
    tasks need no common counter; a task that runs again gives the same rows.
    """
    separator = np.array([SEPARATOR], dtype="<u4").tobytes()

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        encode = encoder(tokenizer).encode
        packer, base = Packer(tokens, segments, loss, window), TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}  # documents with waiting pieces: [doc_id, ids, waiting ids]
        rows: list[tuple] = []

        def emit(sequence: int, chosen: list[tuple]) -> None:
            offset = 0
            for n, (key, start, length, loss_tokens) in enumerate(chosen):
                doc = held[key]
                crc = zlib.crc32(memoryview(doc[1])[4 * start : 4 * (start + length)])
                rows.append((doc[0], start, length, crc, len(doc[1]) // 4, base + sequence, offset, n, loss_tokens))
                offset += length
                doc[2] -= length
                if not doc[2]:
                    del held[key]

        def columns() -> Columns:
            out = dict(zip(_COLUMNS, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in _COLUMNS}
            rows.clear()
            return out

        number = 0
        for batch in batches:
            for doc_id, text, bears in zip(batch["doc_id"], batch["text"], batch["bears"], strict=True):
                ids = encode(text) + separator
                length = len(ids) // 4
                held[number] = [doc_id, ids, length]
                for done in packer.add(number, 0, length, length - 1 if bears else 0):
                    emit(*done)
                number += 1
            yield columns()
        for done in packer.finish():
            emit(*done)
        yield columns()

    bears = F.lit(True) if bears_loss is None else F.coalesce(bears_loss, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), bears.alias("bears"))
    return map_columns(rows, run, _SCHEMA)


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_vector_packing": op4_vector_packing}
