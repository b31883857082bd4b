"""Operator 2: token counts by a compiled finite-state transducer.

Sub-word encoding by ranked merges is a deterministic left-to-right transduction: the token that ends at a
position is the longest vocabulary piece ending there that may follow the token before it. The transducer's
state after a character is the Aho-Corasick node (longest suffix that is a prefix of a piece) with, for every
position still inside that suffix, the token that ended there and its count relative to the present one. Each
transition is annotated with the change in the number of emitted tokens. States are built when first met and kept.

A word mark after another character leads to one state whatever went before, since no piece holds a mark after a
letter; so does a character outside the vocabulary. A chunk of text therefore acts on any state through a short *state
map*: the head up to the first such reset, whose tokens depend on the state it is entered in, then a fixed count and
the fixed state that the chunk ends in. State maps compose associatively: the right one's head is walked from the
left one's end state, so no character is walked twice however long the text is.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, Recent, map_columns
from lexforge.session import table

MARK = "▁"
#: A token count above this is over the limit.
LIMIT = 4096
#: Code points of a chunk, whose state maps are composed.
CHUNK = 1 << 16
#: States that a worker shares between texts, and words whose counts it keeps (twice as many at most).
KEPT_STATES, KEPT_WORDS = 600_000, 400_000

_SEGMENT, _WORD_START = re.compile(f"{MARK}+[^{MARK}]*"), re.compile(f"(?<=[^{MARK}]){MARK}")


class State:
    """A state of the transducer: suffix, for each of its positions the token that ended there and its count relative
    to the last, and the transitions built so far, each to a state and a number of tokens."""

    __slots__ = ("suffix", "ends", "next")

    def __init__(self, suffix: str, ends: tuple[tuple[str, int], ...]):
        self.suffix, self.ends, self.next = suffix, ends, {}


@dataclass(frozen=True, slots=True)
class StateMap:
    """What a chunk does to the transducer. Without an inner reset all of its text is *head* and there is no end state."""

    head: str
    count: int
    end: State | None


def _check_rules(model_file: str) -> None:
    """Raise unless the model leaves texts as they are but for a mark in front and marks for spaces."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    n, t = model.normalizer_spec, model.trainer_spec
    if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("the model normalises texts; its transducer would need those rules too")
    if t.model_type != t.BPE or not t.byte_fallback or t.treat_whitespace_as_suffix:
        raise ValueError("the model does not encode by ranked merges with bytes for what it does not know")


class Transducer:
    """Lazily determinised counting transducer of one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        _check_rules(model_file)
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.rank: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("the vocabulary joins words; its transducer has no reset state")
        if not {c for p in self.rank for c in p} <= self.rank.keys():
            raise ValueError("a character of the vocabulary is not a piece itself")
        self.prefixes = {p[:i] for p in self.rank for i in range(1, len(p) + 1)}
        self._joins: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self.counts = Recent(self._count, KEPT_WORDS)
        self._states: dict[tuple, State] = {}
        self.start = State("", (("", 0),))
        known = "".join(sorted(c for c in self.rank if len(c) == 1 and c != MARK))
        #: A reset: a mark after another character, or a character outside the vocabulary.
        self._reset = re.compile(f"(?<=[^{MARK}]){MARK}|[^{MARK}{re.escape(known)}]")

    # -- the vocabulary's pair rule

    def _merge(self, text: str) -> list[str]:
        """Encoding of a short text by ranked merges: lowest rank first, leftmost on ties."""
        parts = list(text)
        while True:
            best = min(((self.rank.get(a + b, float("inf")), i) for i, (a, b) in enumerate(itertools.pairwise(parts))), default=(float("inf"), 0))
            if best[0] == float("inf"):
                return parts
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]

    def _token(self, piece: str) -> bool:
        """Whether the merges make *piece* from its own characters."""
        found = self._whole.get(piece)
        if found is None:
            found = self._whole[piece] = piece in self.rank and self._merge(piece) == [piece]
        return found

    def _follows(self, left: str, right: str) -> bool:
        """Whether the two tokens stand side by side in the encoding of their text; an empty left one is a barrier."""
        if not left:
            return True
        found = self._joins.get((left, right))
        if found is None:
            found = self._joins[left, right] = self._merge(left + right) == [left, right]
        return found

    # -- the automaton

    def _state(self, suffix: str, ends: tuple[tuple[str, int], ...]) -> State:
        found = self._states.get((suffix, ends))
        if found is None:
            if len(self._states) >= KEPT_STATES:  # states in use stay whole; they are only no longer shared
                self._states = {}
                self.start.next.clear()
            found = self._states[suffix, ends] = State(suffix, ends)
        return found

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The next state and the change in the count of tokens on reading *char*."""
        found = state.next.get(char)
        if found is None:
            found = state.next[char] = self._build(state, char)
        return found

    def _build(self, state: State, char: str) -> tuple[State, int]:
        suffix, ends = state.suffix, state.ends
        if char not in self.rank:
            # Not in the vocabulary: one token per byte, which nothing merges with.
            return self.start, len(char.encode("utf-8", "surrogatepass"))
        if char == MARK and suffix and not set(suffix) <= {MARK}:
            suffix, ends = "", (("", 0),)
        text = suffix + char
        keep = 0
        while keep < len(text) and text[keep:] not in self.prefixes:
            keep += 1
        for at in range(keep, len(text)):
            left, count = ends[at]
            if self._token(text[at:]) and self._follows(left, text[at:]):
                break
        else:
            raise AssertionError(f"no token ends after {text!r}")
        delta = count + 1
        # A position where no piece can start plays no part any more; one form of it makes fewer states.
        kept = [(t, n - delta) if text[keep + i :] in self.prefixes else ("", 0) for i, (t, n) in enumerate(ends[keep:])]
        return self._state(text[keep:], (*kept, (text[at:], 0))), delta

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state after *text* and the tokens that it adds."""
        total = 0
        for char in text:
            found = state.next.get(char)
            state, delta = found if found is not None else self.step(state, char)
            total += delta
        return state, total

    # -- state maps of chunks

    def map_of(self, chunk: str) -> StateMap:
        """The state map of a chunk that may start anywhere in a text."""
        first = self._reset.search(chunk)
        if not first:
            return StateMap(chunk, 0, None)
        head, at, count = chunk[: first.start()], first.start(), 0
        if chunk[at] != MARK:
            word = _WORD_START.search(chunk, at)
            if not word:
                end, count = self.walk(self.start, chunk[at:])
                return StateMap(head, count, end)
            count = self.walk(self.start, chunk[at : word.start()])[1]
            at = word.start()
        # Of all words but the last only the counts matter; the last one's state is what the chunk ends in.
        last = len(chunk)
        while (last := chunk.rfind(MARK, at, last)) > at and chunk[last - 1] == MARK:
            pass
        end, tail = self.walk(self.start, chunk[last:])
        return StateMap(head, count + self.total(chunk[at:last]) + tail, end)

    def total(self, text: str) -> int:
        """Tokens of a text that begins with a mark (or is empty), from the start state."""
        if MARK * 2 in text:
            return sum(self.counts.all(_SEGMENT.findall(text)))
        return sum(self.counts.all(text.split(MARK)[1:]))

    def _count(self, word: str) -> int:
        """Tokens of one word from the start state; one leading mark may be left out."""
        return self.walk(self.start, word if word.startswith(MARK) else MARK + word)[1]

    def compose(self, left: StateMap, right: StateMap) -> StateMap:
        """The state map of two neighbouring chunks; associative."""
        if left.end is None:
            seam = self._reset.search(left.head + right.head, max(0, len(left.head) - 1))
            if seam:  # the first chunk's last letter and the next one's mark make a reset
                whole, at = left.head + right.head, seam.start()
                end, count = self.walk(self.start, whole[at:])
                left, right = StateMap(whole[:at], count, end), StateMap("", right.count, right.end)
            else:
                return StateMap(left.head + right.head, right.count, right.end)
        end, count = self.walk(left.end, right.head)
        return StateMap(left.head, left.count + count + right.count, end if right.end is None else right.end)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text: the composed state map of its chunks, applied to the start state."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if len(marked) <= chunk:
            return self.total(marked)  # one chunk, entered in the start state
        maps = [self.map_of(marked[i : i + chunk]) for i in range(0, len(marked), chunk)]
        while len(maps) > 1:  # a balanced tree: the shape of a parallel scan
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.walk(self.start, maps[0].head)[1] + maps[0].count


_compiled: dict[str, Transducer] = {}


def transducer(model_file: str) -> Transducer:
    """The transducer of a model, compiled once in a Python process."""
    if model_file not in _compiled:
        _compiled[model_file] = Transducer(model_file)
    return _compiled[model_file]


def _resolve(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit and n_chunks of every row's whole text.

    A null text counts as an empty one (no tokens); very long texts are cut into chunks whose maps are composed; null
    and repeated ids and repeated rows are kept as they are, an empty table gives no rows, and other columns are
    ignored whatever their names. *model* is a file of the public tokenizers, or a path. No shuffle takes place.
    """

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        count = transducer(_resolve(model)).count
        for batch in batches:
            texts = batch.pop("text")
            yield batch | {"n_tokens": list(map(count, texts)), "n_chunks": [-(-(len(t) + 1) // CHUNK) if t else 0 for t in texts]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    found = map_columns(rows, run, "doc_id long, n_bytes long, n_tokens long, n_chunks long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit).select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
