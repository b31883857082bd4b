"""Operators 11 and 12: every edit sequence of small conversations, DuckDB and plain Python for whole tables, awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexforge.llm import audit, repair
from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"


def cheapest(texts):
    """(cost, audit, lines) of the least of all edit sequences of a few rows (role, text)."""
    faults, seen = [], set()
    for role, text in texts:
        body = text.strip(" \t\n\v\f\r")
        faults.append("gone" if not body or (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    choices = []
    for (role, text), fault in zip(texts, faults, strict=True):
        late = 5 if fault == "cut" else 0
        kept = [] if fault == "gone" else [("K", late, [(role, text)])] + [("R", 1 + late, [(r, text)]) for r in ("user", "assistant")]
        choices.append([("D", 2, []), *kept])
    made = {"": [], "I": ["user"], "J": ["assistant"], "II": ["user", "assistant"], "JJ": ["assistant", "user"]}
    gaps = [("I" * len(v), 5 * len(v), [(r, "") for r in v]) for v in made.values()]
    best = None
    for parts in itertools.product(gaps, *itertools.chain.from_iterable((c, gaps) for c in choices)):
        lines = [x for p in parts for x in p[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
            found = (sum(p[1] for p in parts), "".join(p[0] for p in parts), [f"{r}:{t}" for r, t in lines])
            best = min(best, found) if best else found
    return best


def test_layers_equal_all_edit_sequences():
    rng = random.Random(4)
    for _ in range(150):
        texts = [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant", " "]), rng.choice(["A.", "B", "C!", " \n", "D?"])) for _ in range(rng.randrange(4))]
        cost, letters, lines = cheapest(texts)
        found = repair.repair_rows([(k, r, t) for k, (r, t) in enumerate(texts)])
        assert found[5:7] == (cost, letters), texts
        assert found[7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_costs_between_states_equal_a_plain_search():
    rng = random.Random(6)
    for _ in range(60):
        turns = [repair.Turn(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 7))]
        plain = []
        for start in repair.STATES:
            costs = {start: 0}
            for turn in [*turns, None]:
                for _ in range(3):
                    for s, c in list(costs.items()):
                        to = repair._next(repair._wanted(s), s)
                        costs[to] = min(costs.get(to, repair.NEVER), c + 5)
                if turn:
                    after = {s: c + 2 for s, c in costs.items()}
                    for s, c in () if turn.gone else costs.items():
                        late = 5 * turn.truncated
                        for to, more in ((repair._next(turn.initial, s), 0), (repair._next(repair._wanted(s), s), 1)):
                            if to:
                                after[to] = min(after.get(to, repair.NEVER), c + late + more)
                    costs = after
            plain += [costs.get(s, repair.NEVER) for s in repair.STATES]
        assert repair.between(turns) == plain


def plain_rows(found):
    """conv_id and result columns of rows (conv_id, turn, role, text), written from the rules."""
    space = lambda x: " " if x is None else x
    groups = {}
    for conv, turn, role, text in found:
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        yield conv, *repair.repair_rows(group)


def test_whole_table_in_groups_and_in_blocks(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    want = sorted(plain_rows(map(tuple, given.select("conv_id", "turn", "role", "text").collect())))
    assert sorted(map(tuple, repair.repair(given).collect())) == want and len(want) == given.select("conv_id").distinct().count()
    assert sorted(map(tuple, repair.repair(given, group_rows=5).collect())) == want


def test_a_conversation_of_many_blocks_and_awkward_rows(spark):
    rng = random.Random(8)
    found = [(1, k, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), f"{rng.choice('abc')} {rng.randrange(600)}{rng.choice('.!? ')}") for k in range(1500)]
    found += [(2, None, None, None), (2, 1, "user", "Hi."), (2, 1, "user", "Hi."), (2, None, "assistant", "x" * 200_000), (None, 1, "user", "No id."), (None, None, None, "a"), (3, 5, "", ""), (4, 9, "user", "  ")]
    found += [(c, t, "user", "A.") for c in range(20, 40) for t in range(2)]
    given = spark.createDataFrame(found, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("conv", "copies", "pos", "block", "kind", "n", "size", "audit", "cost", "tie", "first", "row_key")})
    want = {r[0]: r[1:] for r in plain_rows(found)}
    for limits in ({}, {"group_rows": 1}, {"group_rows": 1000}, {"group_bytes": 100}):
        assert {r[0]: tuple(r[1:]) for r in repair.repair(given, **limits).collect()} == want
    assert repair.repair(given.limit(0)).count() == 0
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    alone = repair.repair(spark.createDataFrame([(dropped, 0, "user", "A.")], given.select("conv_id", "turn", "role", "text").schema)).collect()
    assert [tuple(r) for r in alone] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# -- 12: filter interaction audit


def test_audit_equals_sql(spark):
    for name, sql in audit.ORACLE_SQL.items():
        assert rows(audit.QUERIES[name](spark, SF).toPandas()) == rows(duck(sql, SF))


def test_audit_of_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    found = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (None, long, "en"), (3, None, None), (4, "", ""), (5, "A" * 50_000, "de"), (6, f"{long} $", None), (7, "a b " * 200, "de")]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "bits", "good", "bad", "digest", "n", "first", "words", "body", "step", "quality")})
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (2, 1, 0), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    fails = {0: "", 1: "E", 2: "E", 3: "", 4: "A", 5: "AE", 6: "AC", 7: "D", 8: "B"}
    said = {1: (True, True), 2: (True, False), 7: (False, True)}
    want = {}
    for part in {"en", "", "de"}:
        members = [(set(fails[k]), *said.get(d, (False, False))) for k, (d, _, lang) in enumerate(found) if (lang or "") == part]
        taken = {f: 0 for f in "ABCDE"}
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [m for m in members if f in m[0] and not m[0] & before]
                taken[f] += len(here)
                kept = sum(not m[0] & (before | {f}) for m in members)
                want[part, order, step] = [kept, len(here), sum(f in m[0] and bool(m[0] & before) for m in members), sum(m[0] == {f} for m in members), sum(m[1] for m in here), sum(m[2] for m in here), f]
        for key in [k for k in want if k[0] == part]:
            want[key][-1] = taken[want[key][-1]]
    got = {tuple(r[:3]): list(r[3:]) for r in audit.audit(docs, labels).collect()}
    assert got == want and len(got) == 1800
    assert audit.audit(docs.limit(0), labels).count() == 0
    none = audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0]
    assert none == 0
