"""Operator 11: repair of conversation structure by cost layers over a grammar of roles.

A conversation is legal when its role initials read ``(s?(ua)+)?``. The grammar has four states (nothing yet, after the
system turn, after a user turn, after an assistant turn), so the states that can still reach an accepting end fit in a
four-bit set. Layer *c* holds one such set for each turn: the states from which the rest can be repaired at a cost of at
most *c*. Layers are built for increasing costs, each from the layers one edit below it; the first layer whose set at
the first turn holds the start state gives the cost. Walking from there through the layers, always by the least letter
that stays within them, gives the least audit: a letter leads to one state only, so the choice at each turn is final.

Conversations beyond ``GROUP_ROWS`` or ``GROUP_BYTES`` are cut into blocks. A block's least costs from each state
to each other come from the same layers; the costs behind a block are chained over a conversation's blocks (sixteen
numbers each), every block is then traced for itself from each state, and the chosen traces are chained. Only the
digest of such a conversation has to pass one task, as a stream: SHA-256 has no parallel form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import Columns, hot_join, map_columns
from lexforge.session import Scratch, table

#: A conversation is handled as one group up to so many rows and bytes, and in blocks beyond.
GROUP_ROWS, GROUP_BYTES = 2048, 16 << 20
#: So many keys of long conversations are broadcast at most; more of them are met by a shuffled join.
SENT_KEYS = 200_000
#: Rows in a block of a longer conversation, as a power of two.
BLOCK_POWER = 8

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
STATES = (START, SYSTEM, USER, ASSISTANT)
NEVER = 1 << 60
#: Costs at the end of a conversation: nothing at all and a pair's end are legal.
END = (0, NEVER, NEVER, 0)
#: From which states a role leads on, and to which.
_STEPS = {"s": (START, SYSTEM), "u": (START | SYSTEM | ASSISTANT, USER), "a": (USER, ASSISTANT)}
_BLANKS = " \t\n\v\f\r"


@dataclass(frozen=True)
class Turn:
    """What the grammar sees of a row: its role's initial, whether it must go, and whether it is cut off."""

    initial: str
    gone: bool
    truncated: bool


def _before(initial: str, after: int) -> int:
    """The states from which *initial* leads into the set *after*."""
    source, target = _STEPS.get(initial, (0, 0))
    return source if target & after else 0


def _next(initial: str, state: int) -> int:
    source, target = _STEPS.get(initial, (0, 0))
    return target if state & source else 0


def _wanted(state: int) -> str:
    """The role that an edit puts at *state*; a system turn is never made."""
    return "a" if state == USER else "u"


class Layers:
    """Cost layers of a run of turns before an end whose states cost *end*; built as far as they are asked for."""

    def __init__(self, turns: list[Turn], end: tuple[int, ...] = END, last: bool = True):
        self.turns, self.end, self.last = turns, end, last
        self.sets: list[list[int]] = []

    def _grow(self) -> None:
        cost, n, old = len(self.sets), len(self.turns), self.sets
        made = [0] * (n + 1)
        made[n] = sum(s for s, c in zip(STATES, self.end, strict=True) if c <= cost)
        below = lambda less: old[cost - less] if cost >= less else None
        deleted, rerole, insert, cut, cut_rerole = below(DELETE), below(REROLE), below(INSERT), below(TRUNCATED), below(REROLE + TRUNCATED)
        edits = lambda after: _before("u", after) | _before("a", after)
        if insert and self.last:
            made[n] |= edits(insert[n])
        for i in range(n - 1, -1, -1):
            turn, here = self.turns[i], 0
            if deleted:
                here = deleted[i + 1]
            if insert:
                here |= edits(insert[i])
            if not turn.gone:
                keep, change = (cut, cut_rerole) if turn.truncated else (made, rerole)
                if keep:
                    here |= _before(turn.initial, keep[i + 1])
                if change:
                    here |= edits(change[i + 1])
            made[i] = here
        self.sets.append(made)

    def within(self, cost: int, i: int, state: int) -> bool:
        """Whether the turns from *i* on can be repaired from *state* at a cost of at most *cost*."""
        if cost < 0:
            return False
        while len(self.sets) <= cost:
            self._grow()
        return bool(self.sets[cost][i] & state)

    def cost(self, state: int = START) -> int:
        """The first layer that holds *state* before the first turn."""
        found = 0
        while not self.within(found, 0, state):
            found += 1
        return found

    def trace(self, state: int = START) -> tuple[str, int]:
        """The least audit of the cheapest edits from *state*, and the state after the last turn."""
        rest, i, audit, n = self.cost(state), 0, [], len(self.turns)
        while i < n or self.end[STATES.index(state)] > rest:
            turn = self.turns[i] if i < n else None
            extra = TRUNCATED if turn and turn.truncated else 0
            edit = _next(_wanted(state), state)
            kept = _next(turn.initial, state) if turn and not turn.gone else 0
            if turn and self.within(rest - DELETE, i + 1, state):
                letter, after, paid = "D", state, DELETE
            elif (turn or self.last) and self.within(rest - INSERT, i, edit):
                letter, after, paid = "I", edit, INSERT
            elif kept and self.within(rest - extra, i + 1, kept):
                letter, after, paid = "K", kept, extra
            else:
                letter, after, paid = "R", edit, REROLE + extra
            audit.append(letter)
            i, state, rest = i + (letter != "I"), after, rest - paid
        return "".join(audit), state


def between(turns: list[Turn]) -> list[int]:
    """Least costs of a block from each state (rows) to each state after it (columns); NEVER where there is no way.

    Nothing kept is the only way to stay before the first pair, so those columns need no layers.
    """
    n = len(turns)
    away = DELETE * n
    systems = [TRUNCATED * t.truncated for t in turns if not t.gone and t.initial == "s"]
    first = [away, away - DELETE + min(systems) if systems else NEVER]
    rows = [[first[0], first[1]], [NEVER, away], [NEVER, NEVER], [NEVER, NEVER]]
    for k in (2, 3):
        layers = Layers(turns, tuple(0 if j == k else NEVER for j in range(4)))
        for row, state in zip(rows, STATES, strict=True):
            row.append(layers.cost(state))
    return [c for row in rows for c in row]


def _after(initial: str, edits: str, state: int) -> int:
    """The state after the edits at one row."""
    for letter in edits:
        if letter != "D":
            state = _next(initial if letter == "K" else _wanted(state), state)
    return state


def repaired(turns: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[str]:
    """The lines ``role:text`` after the edits of *audit*, from *state* on."""
    rows = iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "IR":
            role = "assistant" if _wanted(state) == "a" else "user"
        state = _next(role[:1], state)
        yield f"{role}:{text}"


def faults(rows: Iterable[tuple[str, str]]) -> list[str]:
    """The first fault of each row (role, text): blank, duplicate, truncated, or an empty string."""
    seen, found = set(), []
    for row in rows:
        text = row[1].rstrip(_BLANKS)
        found.append("blank" if not text else "duplicate" if row in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add(row)
    return found


def illegal(initials: str) -> int:
    """Neighbours whose initials do not follow each other in any legal conversation."""
    return sum(pair not in ("su", "ua", "au") for pair in _pairs(initials))


def _pairs(initials: Iterable[str]) -> Iterator[str]:
    before = None
    for initial in initials:
        if before is not None:
            yield before + initial
        before = initial


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0, 1 or 2) of every row, harmed by the checksum of ``conv_id:turn``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return given.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def repair_rows(rows: list[tuple]) -> tuple:
    """The result columns of one conversation, given as (turn, role, text) in order."""
    texts = [(role, text) for _, role, text in rows]
    found = faults(texts)
    layers = Layers([Turn(r[:1], f in ("blank", "duplicate"), f == "truncated") for (r, _), f in zip(texts, found, strict=True)])
    audit, _ = layers.trace()
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(repaired(texts, audit)).encode()).hexdigest()
    counts = [found.count(kind) for kind in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal([r[:1] for r, _ in texts]), layers.cost(), audit, digest)


def _grouped(rows: DataFrame) -> DataFrame:
    """Conversations that fit in one group each."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies")))
    groups = rows.groupBy("conv_id").agg(ordered.alias("rows"))
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            found = [repair_rows([(r["turn"], r["role"], r["text"]) for r in rows for _ in range(r["copies"])]) for rows in b["rows"]]
            yield {"conv_id": b["conv_id"]} | {name: [f[k] for f in found] for k, name in enumerate(names)}

    return map_columns(groups, run, f"conv_id long, {OUT}")


def _in_blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Conversations of any length: rows in one order over all tasks, blocks of it, and their chained costs and traces."""
    spark, tie = rows.sparkSession, "tie"
    order = ["conv_id", "turn", "role", "text", tie]
    kept = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).withColumn("there", F.col("copies") > 0)
    spread = kept.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    at = scratch.cut(spread.select(*order[:4], "there", F.monotonically_increasing_id().alias("pos")), "ordered")
    body = F.rtrim(F.translate("text", _BLANKS[1:], " " * 5))
    whole = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), "role", "text"), 256)
    seen = scratch.cut(at.where("there").select("conv_id", "turn", "pos", F.substring("role", 1, 1).alias("initial"), (body == "").alias("blank"), (~body.rlike("[.!?]$")).alias("open"), whole.alias("row_key")), "seen")
    firsts = seen.groupBy("row_key").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    marked = hot_join(seen, firsts, "row_key", seen.count())
    fault = F.when(F.col("blank"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    turns = scratch.cut(marked.select("conv_id", "turn", "pos", F.shiftright("pos", BLOCK_POWER).alias("block"), "initial", fault.alias("fault")), "turns")
    blocks = scratch.cut(turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "initial", "fault"))).alias("rows")), "blocks")
    last = blocks.groupBy("conv_id").agg(F.max("block").alias("last"))
    of = lambda found: [Turn(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in found]

    def costs(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            yield {"conv_id": b["conv_id"], "block": b["block"], "costs": [between(of(r)) for r in b["rows"]], "initials": [r[0]["initial"] for r in b["rows"]], "finals": [r[-1]["initial"] for r in b["rows"]], "within": [illegal([x["initial"] for x in r]) for r in b["rows"]]}

    summed = map_columns(blocks, costs, "conv_id long, block long, costs array<long>, initials string, finals string, within long")
    chains = summed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "costs", "initials", "finals", "within"))).alias("chain"))

    def behind(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            for conv, chain in zip(b["conv_id"], b["chain"], strict=True):
                ends, after = [], list(END)
                for link in reversed(chain):
                    ends.append(after)
                    after = [min(NEVER, *(link["costs"][4 * s + t] + after[t] for t in range(4))) for s in range(4)]
                pairs = [a["finals"] + z["initials"] for a, z in zip(chain, chain[1:], strict=False)]
                wrong = sum(x["within"] for x in chain) + sum(p not in ("su", "ua", "au") for p in pairs)
                n = len(chain)
                yield {"conv_id": [conv] * n, "block": [x["block"] for x in chain], "end": ends[::-1], "cost": [after[0]] * n, "illegal": [wrong] * n}

    known = scratch.cut(map_columns(chains, behind, "conv_id long, block long, end array<long>, cost long, illegal long"), "behind")
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    asked = blocks.join(known, same(blocks, known)).select(blocks["conv_id"], blocks["block"], "rows", "end")
    asked = asked.join(last.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "block", "rows", "end", (F.col("block") == F.col("last")).alias("is_last"))

    def traces(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            audits, states = [], []
            for found, end, is_last in zip(b["rows"], b["end"], b["is_last"], strict=True):
                least = min(end)
                layers = Layers(of(found), tuple(min(NEVER, e - least) for e in end), is_last)
                ways = [layers.trace(s) for s in STATES]
                audits.append([a for a, _ in ways])
                states.append([STATES.index(s) for _, s in ways])
            yield {"conv_id": b["conv_id"], "block": b["block"], "audits": audits, "states": states}

    traced = scratch.cut(map_columns(asked, traces, "conv_id long, block long, audits array<string>, states array<int>"), "traced")
    links = traced.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "states"))).alias("chain"))

    def entered(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            for conv, chain in zip(b["conv_id"], b["chain"], strict=True):
                state, found = 0, []
                for link in chain:
                    found.append(state)
                    state = link["states"][state]
                yield {"conv_id": [conv] * len(chain), "block": [x["block"] for x in chain], "state": found}

    states = map_columns(links, entered, "conv_id long, block long, state int")
    chosen = F.element_at("audits", F.col("state") + 1).alias("audit")
    picked = scratch.cut(traced.join(states, same(traced, states)).select(traced["conv_id"], traced["block"], "state", chosen), "audits")

    # Letters of a block by row: insertions stand before the row that follows them, or behind the last one.
    def letters(batches: Iterator[Columns]) -> Iterator[Columns]:
        for b in batches:
            for block_rows, audit, state in zip(b["rows"], b["audit"], b["state"], strict=True):
                out, edits, begun = [], "", STATES[state]
                rows = iter(block_rows)
                for letter in audit:
                    edits += letter
                    if letter != "I":
                        out.append((next(rows), edits, begun))
                        begun, edits = _after(out[-1][0]["initial"], edits, begun), ""
                if edits and out:
                    out[-1] = (out[-1][0], out[-1][1] + edits, out[-1][2])
                yield {"pos": [r["pos"] for r, _, _ in out], "edits": [e for _, e, _ in out], "begun": [s for _, _, s in out]}

    by_row = map_columns(blocks.join(picked, same(blocks, picked)).select("rows", "audit", "state"), letters, "pos long, edits string, begun int")
    stream = at.join(by_row, "pos").select("conv_id", "pos", "role", "text", "edits", "begun").repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def digests(batches: Iterator[Columns]) -> Iterator[Columns]:
        now, digest, lines = object(), None, 0
        for b in batches:
            for conv, role, text, edits, begun in zip(b["conv_id"], b["role"], b["text"], b["edits"], b["begun"], strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        yield {"conv_id": [now], "repaired_sha256": [digest.hexdigest()]}
                    now, digest, lines = conv, hashlib.sha256(), 0
                for line in repaired([(role, text)], edits, begun):
                    digest.update((b"\n" if lines else b"") + line.encode())
                    lines += 1
        if digest is not None:
            yield {"conv_id": [now], "repaired_sha256": [digest.hexdigest()]}

    hashed = map_columns(stream, digests, "conv_id long, repaired_sha256 string")
    audits = picked.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    kinds = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    spans = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).alias("span"), *kinds)
    distinct = turns.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("*").alias("turns"))
    totals = known.groupBy("conv_id").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    every = at.groupBy("conv_id").agg(F.count("*").alias("all_rows"))
    for part in (spans, distinct, totals, audits, hashed):
        part = part.withColumnRenamed("conv_id", "of")
        every = every.join(part, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    gaps = (F.coalesce("span", F.lit(0)) - F.coalesce("turns", F.lit(0))).cast("long").alias("gaps")
    text = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return every.select("conv_id", gaps, *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), text("audit", ""), text("repaired_sha256", _EMPTY))


def repair(conversations: DataFrame, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, after :func:`damage`.

    Rows come by turn, a null turn first, and by role and text where turns are equal. A null id is a conversation of its
    own; a null role or text is one space; a role that begins with none of s, u, a can only be deleted or given another.
    Repeated rows count as rows, so the later ones are duplicates. Texts of any length are read whole. A conversation of
    which no row is left has zeros, an empty audit and the digest of an empty string; an empty table gives no rows.
    Columns beside the four are ignored.
    """
    scratch = Scratch(conversations.sparkSession)
    rows = scratch.cut(damage(conversations).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))), "damaged")
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("size"))
    long = scratch.cut(sizes.where((F.col("n") > group_rows) | (F.col("size") > group_bytes)).select("conv"), "long")
    n = long.count()
    if not n:
        return _grouped(rows.drop("conv"))
    keys = F.broadcast(long) if n <= SENT_KEYS else long
    short = _grouped(rows.join(keys, "conv", "left_anti").drop("conv"))
    return short.unionByName(_in_blocks(rows.join(keys, "conv", "left_semi").drop("conv"), scratch))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {"op11_structure_repair": op11_structure_repair}
