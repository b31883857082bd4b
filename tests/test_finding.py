"""References in running text: tails in all orders and counter-cases, ways back to raw texts, choices of spans."""

import datetime
import itertools
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexforge.operators import citelist, finder, places, references, spans, terms


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "paragraph long, text string")
    return finder.find(df).orderBy("paragraph", "start").collect()


def test_tails_in_every_order(spark):
    pieces = {" E. 2.3 und 2.4": "n", ", S. 118 ff.": "e", " vom 6. April 2013": "d"}
    texts = [f"Siehe {label}{''.join(order)}; 12 Personen" for label in ("4A_1/2012", "BGE 140 III 115") for n in range(4) for order in itertools.permutations(pieces, n)]
    rows = found(spark, *texts)
    assert len(rows) == len(texts)
    for text, r in zip(texts, rows, strict=True):
        assert r.written == text[6:].removesuffix("; 12 Personen") and (r.start, r.end) == (6, len(text) - 13)
        assert r.pinpoints == (["2.3", "2.4"] if "E. 2.3" in text else []) and r.pages == ([118] if "S. 118" in text else [])
        assert r.written_date == ("2013-04-06" if "April" in text else None)


@pytest.mark.parametrize(
    ("text", "written"),
    [
        ("4A_1/2012 E. 1, E. 2, E. 3, E. 4, E. 5", "4A_1/2012 E. 1, E. 2, E. 3, E. 4"),  # four at most
        ("4A_1/2012 CONSID. 3, 4 ET 5 z", "4A_1/2012 CONSID. 3, 4 ET 5"),
        ("4A_1/2012 E. 2 und 141 Personen", "4A_1/2012 E. 2"),  # numbers after the first have two digits
        ("4A_1/2012 consid. 2 et 4A_2/2012", "4A_1/2012 consid. 2"),
        ("4A_1/2012 E. 2.1 2013", "4A_1/2012 E. 2.1"),
        ("4A_1/2012 vom Montag", "4A_1/2012"),
        ("4A_1/2012 S. 12345", "4A_1/2012"),
        ("4A_1/2012  E. 3a-4", "4A_1/2012 E. 3a-4"),
        ("4A_1/2012, pag. 9 s. del 3.5.2015", "4A_1/2012, pag. 9 s. del 3.5.2015"),
        ("4A_1/2012 dell'1 marzo 2015", "4A_1/2012 dell'1 marzo 2015"),
    ],
)
def test_tails_and_what_is_none(spark, text, written):
    assert found(spark, text)[0].written == written


def test_a_tail_that_would_change_the_label_is_refused(spark):
    df = spark.createDataFrame([("VB 12", " E. 1, S. 2 vom 3. Mai 2014"), ("VB 12", " vom 3. Mai 2014 E. 1")], "label string, rest string")
    read = r"^VB 12(?: E\. 1, S\. 2)?"  # a finder for which the page belongs to the label
    assert [r[0] for r in df.select(finder.tails(F.col("label"), F.col("rest"), read)).collect()] == [" E. 1", " vom 3. Mai 2014 E. 1"]


def test_chains_courts_and_pages(spark):
    rows = found(spark, "BGE 140 III 115 E. 2; 141 III 569 E. 3, vgl. 142 I 7; dann 143 I 8", "Urteil des Bundesverwaltungsgerichts A-12/2010. Es folgt B-13/2011", "BGE 129 III 320, 324; BGE 129 III 320, 2003; BGE 129 III 320, 141 III 3", None, "")
    assert [r.key for r in rows if r.paragraph == 0] == ["BGE 140 III 0115", "BGE 141 III 0569", "BGE 142 I 0007"]
    assert [(r.key, r.courts) for r in rows if r.paragraph == 1] == [("A-12/2010", ["bvger"]), ("B-13/2011", [])]
    assert [r.pages for r in rows if r.paragraph == 2] == [[324], [], [], []]
    assert {r.paragraph for r in rows} == {0, 1, 2}


def test_places_lead_back_to_the_raw_text():
    rng = random.Random(1)
    for _ in range(3000):
        raw = "".join(rng.choice(["a", "é", "Zü", "  ", " ", "4A_1 / 2012", "A-12/ 2010", "b", "́", "각", "\n", " "]) for _ in range(rng.randrange(14)))
        text, at, back = places.normalised_text(raw)
        assert places.composed(raw)[0] == unicodedata.normalize("NFC", raw)
        starts = places.place(at, back, range(len(text) + 1)).tolist()
        assert starts == sorted(starts) and starts[-1] == len(raw)
        # Every word of the normalised text is the same word in the raw one.
        a = 0
        for word in text.split(" "):
            if word.strip() and not unicodedata.combining(word[0]):
                there = raw[starts[a] : starts[a + len(word)]]
                assert places.normalised_text(there)[0].strip("  \t") == word.strip("  \t")
            a += len(word) + 1


def test_context_words_close_before_a_number(spark):
    texts = ["sentenza 12.2002.183 e 12.2003.4", "Tribunale. 12.2002.183", "Corte " + "x" * 59 + "12.2002.1", "Corte " + "x" * 60 + " 12.2002.1", "inc. n.5 12.2002.1", "112.2002.183 12.2002.18.3 Corte 12.2102.1", "cortesia 12.2002.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "paragraph long, text string")
    assert [(r.paragraph, r.number, r.named) for r in finder.ticino(df).orderBy("paragraph", "start").collect()] == [(0, "12.2002.183", True), (0, "12.2003.4", True), (1, "12.2002.183", False), (3, "12.2002.1", False), (4, "12.2002.1", True), (6, "12.2002.1", True)]
    far = spark.createDataFrame([(1, "EGMR Nr. 4723/13 und 12/99; 5/98"), (2, "EGMR " + "x" * 170 + " 1/99"), (3, "Nr. 7/11")], "paragraph long, text string")
    assert [(r.paragraph, r.number) for r in finder.applications(far).orderBy("paragraph", "start").collect()] == [(1, "4723/13"), (1, "12/99")]


def plain_greedy(rows, order):
    kept = []
    for r in sorted(rows, key=order):
        if r[1] < r[2] and all(r[2] <= k[1] or k[2] <= r[1] for k in kept):
            kept.append(r)
    return sorted(kept)


def test_greedy_choices_equal_a_plain_one(spark):
    rng = random.Random(2)
    rows = [(d, a := rng.randrange(60), a + rng.choice([0, 1, 2, 3, 5, 8, 9, 30]), k) for d in range(12) for k in range(25)]
    df = spark.createDataFrame(rows, "id long, start int, end int, row long")
    by = {d: [r for r in rows if r[0] == d] for d in range(12)}
    assert sorted(map(tuple, spans.widest_first(df).collect())) == sorted(x for g in by.values() for x in plain_greedy(g, lambda r: (r[1] - r[2], r[3], r[1])))
    first = spans.earliest_first(df.where("end > start")).select("id", "start", "end").distinct()
    assert sorted(map(tuple, first.collect())) == sorted({x[:3] for g in by.values() for x in plain_greedy(g, lambda r: (r[1], -r[2]))})
    taken = df.where("row < 3 AND end > start")
    want = [r for r in rows if r[3] >= 3 and r[1] < r[2] and not any(t[3] < 3 and t[1] < t[2] and t[0] == r[0] and t[1] < r[2] and r[1] < t[2] for t in rows)]
    assert sorted(map(tuple, spans.free(df.where("row >= 3 AND end > start"), taken).collect())) == sorted(want)
    assert spans.widest_first(df.limit(0)).count() == 0


def test_only_what_still_reads_so_is_replaced(spark):
    docs = spark.createDataFrame([(1, "Anna und Berta"), (2, "Carla"), (3, None)], "id long, text string")
    shown = spark.createDataFrame([(1, 0, 4, "Anna", "A."), (1, 9, 14, "Berte", "B."), (1, 9, 14, "Berta", "B."), (2, 0, 40, "Carla", "C.")], "id long, start int, end int, written string, label string")
    assert sorted(map(tuple, spans.replace_shown(docs, shown).collect())) == [(1, "A. und B.", 2, 1), (2, "Carla", 0, 1), (3, None, 0, 0)]


def test_one_edit_equals_the_generated_labels(spark):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("0A1_/B2") for _ in range(rng.randrange(1, 5)))
    df = spark.createDataFrame([(make(), make()) for _ in range(3000)], "a string, b string")
    got = df.select("a", "b", citelist.one_edit(F.col("a"), F.col("b")).alias("near"), F.array_contains(citelist.one_edit_away(F.col("a")), F.col("b")).alias("made"))
    wrong = [r for r in got.collect() if r.near != r.made]
    assert not wrong, wrong[:5]


def test_page_status(spark):
    ranges = spark.createDataFrame([("k", 100, 120), ("open", 7, None)], "key string, first int, last int")
    refs = spark.createDataFrame([(1, "k", [99, 110]), (2, "k", [100, 120]), (3, "open", [500]), (4, "open", [6]), (5, "k", []), (6, "none", [1])], "ref_id long, key string, pages array<int>")
    assert [(r.ref_id, r.status, r.outside) for r in references.page_status(refs, ranges).orderBy("ref_id").collect()] == [(1, "page", [99]), (2, "page_inside", []), (3, "open", []), (4, "page", [6])]


def test_snippets_and_context(spark):
    text = "eins zwei drei " * 10
    row = spark.createDataFrame([(text, 75, 79), ("kurz", 0, 4)], "t string, a int, b int").select(finder.snippet(F.col("t"), F.col("a"), F.col("b"), 12).alias("s"), finder.context(F.col("t"), F.col("a"), F.col("b"), 5).alias("c")).collect()
    assert [r.s for r in row] == ["…zwei drei eins zwei drei…", "kurz"] and row[0].c.before == "drei " and row[1].c == ("", "")


def widest(df):
    """The most rows that any step of a plan gave while the rows of *df* were collected."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        nodes += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def hot(spark):
    """Three hundred references to one key of three hundred lines at two courts."""
    lines = [("1A_5/2001", "bger" if k % 2 else "zh_og", "CH" if k % 2 else "ZH", str(datetime.date(2001, 1, 2) + datetime.timedelta(k)), [f"{k % 40}.{k % 7}"], f"d{k}") for k in range(300)]
    refs = [(k, "1A_5/2001", ["bvger"] if k % 3 == 0 else [], None, str(datetime.date(2001, 1, 2) + datetime.timedelta(k * 2)), None, f"{k}.1") for k in range(300)]
    rows = spark.createDataFrame(lines, "key string, court string, canton string, date string, enums array<string>, id string")
    return spark.createDataFrame(refs, "ref_id long, key string, courts array<string>, canton string, written_date string, invalid_date string, pinpoint string"), rows


def test_references_to_a_key_of_many_lines_do_not_meet_them_all(spark):
    refs, rows = hot(spark)
    assert widest(references.check(refs, rows)) < 2000
    assert widest(references.court_issues(refs, rows)) < 2000
    assert widest(references.date_issues(refs, rows)) < 2000
    found = {r.ref_id: r for r in references.check(refs, rows).collect()}
    assert (found[0].status, found[0].issues, found[0].n_listed, found[0].n_scoped) == ("differs", ["court"], 300, 0)
    assert (found[1].status, found[1].issues, found[1].notes, found[1].n_scoped) == ("found", [], ["several"], 300)
    assert (found[151].status, found[151].issues) == ("differs", ["date", "pinpoint"])
    assert {r.ref_id: r.n for r in references.court_issues(refs, rows).collect()} == {k: 300 for k in range(0, 300, 3)}
    assert sorted(r.ref_id for r in references.date_issues(refs, rows).collect()) == [k for k in range(150, 300) if k % 3]


def test_a_date_of_many_lines_is_not_compared_with_all_of_them(spark):
    """A hundred labels of one day and a hundred listed ones: only near ones meet."""
    refs = spark.createDataFrame([(k, f"1A_{k}/2001", "2001-01-02", None, None) for k in range(100, 200)] + [(500, "1A_150/2001", "2001-01-02", ["bger"], None)], "ref_id long, key string, written_date string, courts array<string>, canton string")
    rows = spark.createDataFrame([(f"1A_{k * 10 + 5}/2001", "bger", "CH", "2001-01-02") for k in range(10, 110)] + [("1A_15/2001", "zh_og", "ZH", "2001-01-02")], "key string, court string, canton string, date string")
    assert widest(citelist.date_suggestions(refs, rows)) < 2500
    got = {(r.ref_id, r["rank"]): r.key for r in citelist.date_suggestions(refs, rows).collect()}
    assert [got[150, n] for n in (1, 2, 3)] == ["1A_105/2001", "1A_15/2001", "1A_155/2001"]
    assert [got[500, n] for n in (1, 2, 3)] == ["1A_105/2001", "1A_155/2001", "1A_15/2001"]


def test_texts_are_dealt_out_and_not_broadcast(spark):
    docs = spark.range(20).select("id", F.concat(F.lit("Zu\u0308rich  4A_"), F.col("id").cast("string"), F.lit(" / 2012")).alias("text"))
    found = finder.find(docs.withColumnRenamed("id", "paragraph")).select(F.col("paragraph").alias("id"), "start", "end")
    shown = places.cut(docs, found).select("id", "start", "end", F.col("letters").alias("written"), F.lit("x").alias("label"))
    done = spans.replace_shown(docs, shown)
    for df in (found, shown, done):
        rows = df.collect()
        assert len(rows) == 20 and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.text for r in rows} == {"Zu\u0308rich  x"}


def test_only_what_is_asked_of_a_reference_is_read(spark):
    refs = spark.createDataFrame([(1, "Urteil 4A_5/2012 vom 3. Mai 2013 E. 2.1"), (2, "BGE 140 III 115 E. 3a/bb"), (3, "nichts")], "ref_id long, prose string")
    whole = {r.ref_id: r for r in references.parsed(refs).collect()}
    for column in references.PARSED:
        assert [(r.ref_id, r[column]) for r in references.parsed(refs, column).orderBy("ref_id").collect()] == [(k, whole[k][column]) for k in (1, 2, 3)]
    plan = references.parsed(refs, "key")._jdf.queryExecution().executedPlan().toString()
    assert "januar" not in plan.lower() and "consid" not in plan.lower()


def test_missing_labels_do_not_meet_all_lines_of_near_keys(spark):
    """Three hundred questions about a label that is one error away from a key of three hundred lines."""
    refs, rows = hot(spark)
    refs = refs.withColumn("key", F.lit("1A_6/2001"))
    assert widest(citelist.suggest(refs, rows)) < 5000
    got = {}
    for r in citelist.suggest(refs, rows).orderBy("ref_id", "rank").collect():
        got.setdefault(r.ref_id, []).append((r.court, r.date, r.score))
    lines, day = rows.collect(), {r.ref_id: r for r in refs.collect()}
    for k, ref in day.items():
        met = []
        for r in lines:
            pin = any(e == ref.pinpoint or e.startswith(ref.pinpoint + ".") for e in r.enums)
            met.append(((0 if r.date == ref.written_date else 4) + (0 if pin else 2) + (0 if not ref.courts or r.court in ref.courts else 1), r.court, r.canton, r.date))
        best = min(met)[0]
        assert got[k] == [(c, d, s) for s, c, _, d in sorted(m for m in met if best >= 4 or m[0] < 4)[:3]]


def test_neighbours_of_absent_numbers_are_found_once_a_stem(spark):
    rows = spark.createDataFrame([("k", "c", "ZH", "2001-01-02", ["1.1", "1.2/a", "2", "3.1"])], "key string, court string, canton string, date string, enums array<string>")
    asked = spark.createDataFrame([("k", p) for p in ("1.7", "1.8", "1.9a", "4.1", "9", None)], "key string, pin string")
    levels = citelist.with_levels(rows, asked).first().levels
    assert {s: x.numbers for s, x in levels.items()} == {"1.": ["1.1", "1.2"], "4.": ["1", "2", "3"], "": ["1", "2", "3"]}


def test_references_are_found_in_their_text_s_row(spark):
    """Chains of a text with many pieces, of one that begins with a bare triple, and of one that is broken by another label."""
    texts = ["BGE 140 III 1" + "".join(f"; 141 I {k}" for k in range(1, 900)), "140 III 1; 141 I 2", "BGE 140 III 1, 4A_1/2012; 141 I 2, BGE 1 I 2; 3 I 4 x 5 I 6; 7 I 8"]
    df = finder.find(spark.createDataFrame(list(enumerate(texts)), "paragraph long, text string"))
    rows = df.orderBy("paragraph", "start").collect()
    assert [sum(r.paragraph == k for r in rows) for k in range(3)] == [900, 0, 4] and [r.key for r in rows][-1] == "BGE 003 I 0004"
    assert all(texts[r.paragraph][r.start : r.end] == r.written for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Sort", "Window", "Join")) and plan.count("Exchange") == 1


def test_short_texts_take_one_step_and_long_ones_the_same_choice(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(d, a := rng.randrange(400), a + rng.choice([0, 1, 2, 5, 9, 30, 200]), k) for d, n in ((1, 7), (2, 20), (3, 21), (4, 90)) for k in range(n)]
    rows += rows[:5]  # repeated
    df = spark.createDataFrame(rows, "id long, start int, end int, row long")
    want = sorted(x for d in range(1, 5) for x in plain_greedy({r for r in rows if r[0] == d}, lambda r: (r[1] - r[2], r[3], r[1])))
    for small in (0, 20, 1000):
        assert sorted(map(tuple, spans.widest_first(df, small=small).collect())) == want
    written, cut = [], spans.Scratch.cut
    monkeypatch.setattr(spans.Scratch, "cut", lambda self, table, name: written.append(name) or cut(self, table, name))
    spans.widest_first(df.where("id < 3")).collect()
    assert len(written) <= 2


def test_terms_are_found_in_their_text_s_row(spark):
    texts = spark.createDataFrame([(1, "Zu\u0308rich  Zürich-Nord, Zürich"), (2, None), (3, "nord")], "id long, text string")
    own = spark.createDataFrame([(1, "Zürich Nord"), (2, "zürich"), (3, "Nord , zürich x")], "term_id long, term string")
    df = terms.find_terms(texts, own)
    assert sorted(map(tuple, df.collect())) == [(1, 1, 9, 20), (1, 2, 0, 7), (1, 2, 9, 15), (1, 2, 22, 28)]
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
