"""Each operator against a brute-force version, the libraries it stands for, or exact accounts; with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.llm import decontaminate, htmltext, licences, linedup, neardup, packing, quality, sketch, tokencount, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Nulls in every column, empty and long texts, repeated rows, ties, and columns with names that operators use.
AWKWARD = [(1, "The cat. The dog.", "en", "a", 17, "x"), (1, "The cat. The dog.", "en", "a", 17, "x"), (2, None, None, None, None, None), (3, "", "de", "b", 0, ""), (None, "no id here", "en", "c", 10, "y"), (4, " \n\t ", "fr", "a", 4, "z"), (5, "long " * 20_000, "en", "a", 100_000, "q"), (6, "é" * 5000, "fr", None, 5000, "q")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    for name in ("kept", "id", "body", "n_tokens", "component_id", "key", "gone", "line", "path", "label", "__id", "near_id", "__doc", "__body", "__gone", "line_doc", "hash", "bucket", "bears"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def words(rng, n, vocabulary=400):
    return " ".join("".join("bcdfghjklm"[int(d)] for d in f"{rng.randrange(vocabulary):05d}") for _ in range(n))


LARGE = 2**53 + 1


def test_large_ids_beside_a_null_stay_as_they_are(spark):
    """In every operator of which the rows pass through Python."""
    from lexforge.llm.toxicity import Lexicon

    rows = [(LARGE, "The cat sat on the mat.", "en", "a", 23), (None, "a dog", "en", "b", 5), (LARGE + 2, "One more text, and more.", "de", "a", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    items = spark.createDataFrame([("i", "the cat")], "item_id string, text string")
    untrained = quality.CoTrained(None)
    found = [quality.score_quality(docs, untrained), tokencount.token_counts(docs), packing.pack(docs), sketch.edited_fingerprints(docs), sketch.fingerprints(docs)]
    found += [toxicity.score_toxicity(docs, Lexicon({})), decontaminate.contamination(docs, items), neardup.near_duplicates(docs), linedup.remove_boilerplate(docs)]
    for df in [*found, htmltext.extract(pages).withColumnRenamed("page_id", "doc_id")]:
        assert {r.doc_id for r in df.collect()} == {LARGE, None, LARGE + 2}


# -- 2: token counts


def test_counts_equal_the_library():
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=file), tokencount.Transducer(file), random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("ab the▁  \n\té1234ñ🤖\x00中文.,xyzquck</s>") for _ in range(rng.randrange(60)))
        assert {own.count(text, size) for size in (1, 2, 5, 1000)} == {len(library.encode(text))}


def test_state_maps_compose_in_any_order():
    own = tokencount.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    maps = [own.map_of(c) for c in ("▁ab▁", "▁c", "d", "▁▁e▁f", "g")]
    left, right = maps[0], maps[-1]
    for m in maps[1:]:
        left = own.compose(left, m)
    for m in reversed(maps[:-1]):
        right = own.compose(m, right)
    assert left == right and own.walk(own.start, left.head)[1] + left.count == own.total("▁ab▁▁cd▁▁e▁fg")


def test_a_text_without_spaces_is_walked_once(monkeypatch):
    own, walked = tokencount.Transducer(public_tokenizers.path("piece_bpe_32k.model")), []
    walk = own.walk
    monkeypatch.setattr(own, "walk", lambda state, text: walked.append(len(text)) or walk(state, text))
    text = "abcdefgh" * 1000
    assert own.count(text, 50) == own.count(text, 10**6) and sum(walked) <= 2 * (len(text) + 1)


def test_token_count_rows(awkward, empty):
    rows = tokencount.token_counts(awkward).collect()
    assert len(rows) == len(AWKWARD) and tokencount.token_counts(empty).count() == 0
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows}[2] == (0, 0)
    assert [r.over_limit for r in rows if r.doc_id == 5] == [True]


# -- 4: packing


def test_pieces_cover_every_id_once(awkward, empty):
    rows = packing.pack(awkward, tokens=64, segments=4, loss=64, window=8).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
    for pieces in by_seq.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and len(pieces) <= 4 and sum(p[2] for p in pieces) <= 64
    assert sum(length for _, length, _ in by_doc[5]) == by_doc[5][0][2]
    assert sum(p[1] for p in by_doc[1]) == 2 * by_doc[1][0][2] and by_doc[2] == [(0, 1, 1)]
    assert packing.pack(empty).count() == 0


def test_ids_equal_the_library(spark):
    import numpy as np
    from tokenizers import Tokenizer

    file, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    library, own = Tokenizer.from_file(file), packing.WordEncoder(file)
    for _ in range(500):
        text = "".join(rng.choice("ab THE 'ſ \n\té123Éñ🤖中文.,İΣσxyz's\xa0<|endoftext|>") for _ in range(rng.randrange(40)))
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert own.by_words and not packing.encoder("byte_bpe_50k.json").by_words
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder("byte_bpe_50k.json").encode("Two  words.") == np.array(other.encode("Two  words.").ids, dtype="<u4").tobytes()


def test_whole_rows_equal_the_library(spark):
    """doc_tokens, start, length and ids_crc32 of every piece, from the library's ids for the whole texts."""
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(i, t) for i, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for i, t in docs}
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and 4 * r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    assert sum(r.length for r in rows) == sum(len(b) // 4 for b in ids.values())


def test_a_limit_on_loss_binds(spark):
    """Turns of the assistant bear loss, others none; long ones are cut where the limit on loss is reached."""
    rng = random.Random(12)
    turns = [(i, words(rng, rng.randrange(1, 200), 10**6), i % 2 == 1) for i in range(300)]
    rows = packing.pack(spark.createDataFrame(turns, "doc_id long, text string, own boolean"), tokens=256, loss=96, bears_loss=F.col("own")).collect()
    used = {}
    for r in rows:
        n, k, loss = used.get(r.sequence_id, (0, 0, 0))
        used[r.sequence_id] = (n + r.length, k + 1, loss + r.loss_tokens)
    assert all(n <= 256 and k <= 64 and loss <= 96 for n, k, loss in used.values()) and max(u[2] for u in used.values()) == 96
    assert all(r.loss_tokens == 0 for r in rows if r.doc_id % 2 == 0)
    assert sum(r.loss_tokens for r in rows) == sum({r.doc_id: r.doc_tokens - 1 for r in rows if r.doc_id % 2}.values())


def test_little_padding():
    rng, packer, total, padded = random.Random(1), packing.Packer(), 0, 0
    done = []
    for i in range(2000):
        n = rng.randrange(1, 3000)
        total += n
        done += packer.add(i, 0, n, n - 1)
    done += packer.finish()
    for _, pieces in done:
        used = sum(p[2] for p in pieces)
        padded += used if used & (used - 1) == 0 else 2048
    assert sum(p[2] for _, ps in done for p in ps) == total and padded <= 1.01 * total


def test_little_padding_in_runs_of_short_documents():
    rng, packer, done, lengths = random.Random(2), packing.Packer(), [], []
    for _ in range(3):
        lengths += [rng.randrange(1, 20) for _ in range(1000)] + [rng.randrange(200, 3000) for _ in range(1000)]
    for i, n in enumerate(lengths):
        done += packer.add(i, 0, n, n - 1)
    done += packer.finish()
    used = [sum(p[2] for p in pieces) for _, pieces in done]
    padded = sum(u if u & (u - 1) == 0 else 2048 for u in used)
    assert sum(used) == sum(lengths) and padded <= 1.008 * sum(lengths)


# -- 5: main text


def test_main_text_of_marked_and_unmarked_pages():
    page = "<html><body><header>H</header><nav><ul><li><a href=x>menu</a></ul></nav><div class=cookie-notice>We use cookies to do many things for all of you, dear readers.</div>{}<div class=sidebar><p>links</div><div id=comments><p>nice words of a reader</div><footer>f</footer>"
    body = "<h2>T</h2><p>A long paragraph of text that is content here &amp; there,\n &eacute;.<p>Short.<ul><li>one<li>two</ul>"
    want = "T A long paragraph of text that is content here & there, é. Short. one two"
    assert htmltext.main_text(page.format(f"<article>{body}</article>")) == want
    assert htmltext.main_text(page.format(f"<div id=content>{body}</div>")) == want
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x</script>") == ""


LONG = "The council met on Tuesday evening and talked for three hours about the new bridge over the river."
MORE = "Nobody could say what it would cost, but everyone agreed that the old one would not last the winter."


@pytest.mark.parametrize(("page", "want"), [
    (f'<article><p class="market-share">{LONG}</p><p>{MORE}</p></article>', f"{LONG} {MORE}"),
    (f'<article><div class="notice-of-appeal">{LONG}</div><p>{MORE}</p></article>', f"{LONG} {MORE}"),
    (f'<div class="sidebar"><a href=x>a</a><article><p>{LONG}<p>{MORE}</article>', f"{LONG} {MORE}"),
    (f'<div id=a><p>{LONG}</div><div><p>Yes.</div><div id=b><p>{MORE}</div><footer>f</footer>', f"{LONG} Yes. {MORE}"),
    (f'<article><header class="post-header"><h1>Bridge</h1></header><p>{LONG}</article>', f"Bridge {LONG}"),
    (f'<article><p>{LONG}</p><div class="ad-slot">Buy now.</div><p>{MORE}</p></article>', f"{LONG} {MORE}"),
    (f'<main><h1>Bridge</h1><p>{LONG}</main><section class="comment-list"><article>{MORE}</article></section>', f"Bridge {LONG}"),
    (f'<ul class="navMain"><li><a href=x>one</a></ul><p>{LONG}<br>{MORE}</p><div class="siteFooter">c</div>', f"{LONG} {MORE}"),
    (f'<table><tr><td>{LONG}<td>{MORE}</table><form><p>{LONG}</form>', f"{LONG} {MORE}"),
    (f'<div role="navigation">{MORE}</div><div><blockquote>{LONG}</blockquote></div><div hidden>{MORE}</div>', LONG),
    (f'<article><p>{LONG}</p><div class=comments><p>{MORE}', LONG),
    (f'<article>A &lt;b&gt; &#x41;&#233;&nbsp;x<script>if (a < b) c()</script><!-- {MORE} --><style>p {{}}</style> {LONG}</article>', f"A <b> A\u00e9 x {LONG}"),
])
def test_main_text_of_page_forms(page, want):
    assert htmltext.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == want


def test_main_text_rows(spark):
    rows = [(1, "u", "<p>one"), (None, None, None), (2, "u", "<<<&"), (1, "u", "<p>one")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got)[-1][1] == "<<<&" and len(got) == 4


# -- 6: sketches


def shingles_of(text, size=16):
    return {text[i : i + size] for i in range(max(1, len(text) - size + 1))} if text else set()


def test_sketches_estimate_containment():
    rng = random.Random(3)
    a, b = words(rng, 4000, 10**6), words(rng, 400, 10**6)
    s, t, both = sketch.sketch(a), sketch.sketch(b), sketch.sketch(f"{a} {b}")
    assert sketch.likeness(s, t) < 0.05 and sketch.likeness(t, both) > 0.9 and sketch.likeness(s, both) > 0.97
    assert (sketch.decode(sketch.encode(s)).hashes == s.hashes).all() and sketch.decode(sketch.encode(s)).scale == s.scale
    assert len(sketch.sketch("").hashes) == 0 and len(sketch.sketch("ab").hashes) == 1


def test_merged_sketches_are_those_of_the_union():
    """Short with short, short with long, long with long: at the smaller fraction of both, hash for hash."""
    rng = random.Random(13)
    long, other, short, brief = words(rng, 900, 10**6), words(rng, 300, 10**6), words(rng, 30, 10**6), words(rng, 9, 10**6)
    for x, y in ((long, other), (long, short), (short, brief)):
        merged = sketch.decode(sketch.merge(sketch.encode(sketch.sketch(x)), sketch.encode(sketch.sketch(y))))
        every = sketch.shingle_hashes(x).tolist() + sketch.shingle_hashes(y).tolist()
        assert merged.hashes.tolist() == sorted({h >> 16 for h in every if h < (1 << 64) // merged.scale})


def test_likeness_is_near_the_true_containment():
    """Of texts to their edited texts, in bands of lengths without a cliff: exact for short ones, a mean error below 0.05 in every band."""
    rng, errors = random.Random(14), {}
    texts = [words(rng, 1300, 10**6)[: rng.choice([rng.randrange(30, 300), rng.randrange(272, 700), rng.randrange(700, 2000), rng.randrange(2000, 7000)])] for _ in range(500)]
    for text, after in zip(texts, texts[1:], strict=False):
        changed = sketch.edited(text, after)
        a, b = shingles_of(text), shingles_of(changed)
        error = abs(sketch.likeness(sketch.sketch(text), sketch.sketch(changed)) - len(a & b) / min(len(a), len(b)))
        band = next(k for k, top in enumerate((272, 400, 527, 800, 1100, 2000, 4000, 8000)) if len(text) < top)
        errors.setdefault(band, []).append(error)
    assert sorted(errors) == list(range(8)) and min(map(len, errors.values())) > 15
    assert max(max(errors[k]) for k in (0, 1)) == 0 and all(sum(e) / len(e) < 0.05 for e in errors.values()), {k: sum(e) / len(e) for k, e in errors.items()}


def test_fractions_follow_the_distinct_shingles():
    rng = random.Random(15)
    repeated = "Read our newsletter daily.\n" * 40
    assert (sketch.sketch(repeated).scale, len(sketch.sketch(repeated).hashes)) == (1, len(set(sketch.shingle_hashes(repeated).tolist())))
    for n in (100, 511, 512, 1023, 1024, 4095, 4096, 9000, 40_000):
        text = words(rng, n, 10**6)[: n + 15]
        s = sketch.sketch(text)
        assert s.scale == sketch.own_scale(n) and len(s.hashes) > min(n, 256) * 0.75
    assert [sketch.own_scale(n) for n in (0, 511, 512, 1023, 1024, 2048, 4095, 4096, 10**9)] == [1, 1, 2, 2, 4, 8, 8, 16, 16]


def test_next_documents(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 50))) for i in rng.sample(range(10**6), 300)] + [(7_000_000, None), (7_000_001, "")]
    got = {r.doc_id: r for r in sketch.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        changed = sketch.edited(text or "", after or "")
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
    assert len(got) == len(rows)


def test_an_id_with_very_many_rows_is_cut(spark):
    """Rows without an id, and those of one id, follow each other in one order across the ranges that they are cut into."""
    rng = random.Random(15)
    rows = [(None, words(rng, 8)) for _ in range(200)] + [(5, words(rng, 8)) for _ in range(200)] + [(i, words(rng, 8)) for i in range(100, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.edited_sha256) for r in sketch.edited_fingerprints(docs).collect())
    order = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    assert got == Counter((r.doc_id, hashlib.sha256(sketch.edited(r.text, n.text).encode()).hexdigest()) for r, n in zip(order, order[1:] + order[:1], strict=True))
    assert sketch.with_next(docs).where("doc_id IS NULL").select("bucket").distinct().count() > 1


def test_sketch_awkward(awkward, empty):
    assert sketch.edited_fingerprints(awkward).count() == len(AWKWARD) and sketch.edited_fingerprints(empty).count() == 0
    one = sketch.edited_fingerprints(awkward.where("doc_id = 6")).first()
    assert one.near_next == 1.0
    assert len({r.fingerprint for r in sketch.fingerprints(awkward).where("doc_id = 1").collect()}) == 1


# -- 7: toxicity


def labelled(spark, rows):
    return spark.createDataFrame(rows, "text string, toxic int")


def test_toxicity_lexicon(spark):
    rng = random.Random(6)
    rows = [(words(rng, 60), 0) for _ in range(200)] + [(f"{words(rng, 30)} rotten {words(rng, 30)}", 1) for _ in range(40)] + [(f"{words(rng, 30)} vile {words(rng, 30)}", 1) for _ in range(40)]
    lexicon = toxicity.learn(labelled(spark, rows + [(f"{words(rng, 20)} rotten apples {words(rng, 20)}", 0) for _ in range(8)]))
    score = lambda t: lexicon.score(lexicon.density(toxicity.fold(t))[0])
    assert score("you r0tt3n thing") >= 0.7 and score("v​і​le") >= 0.7 and score("ｖｉｌｅ") >= 0.7
    assert score("rotten apples") < 0.7 and score(words(rng, 3)) < 0.3 and 0 <= score("") < 0.7
    assert toxicity.learn(labelled(spark, [])).score(0.0) == 0.5


def test_every_unlike_training_row_counts(spark):
    """Texts that share some words are not taken for copies; equal ones count once."""
    rng = random.Random(17)
    rows = [(f"shared pair {words(rng, 20)} vile", 1) for _ in range(4)] + [(f"shared pair {words(rng, 20)}", 0) for _ in range(40)]
    assert " vile" in toxicity.learn(labelled(spark, rows)).weights
    assert " vile" not in toxicity.learn(labelled(spark, rows[:1] * 40 + rows[4:])).weights


def test_toxicity_on_the_held_out_fold(spark):
    """Rank correlation with the labels that were not learnt from, over the whole table at sf0.01."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score_toxicity(docs, toxicity.learn(toxicity.training_rows(docs, labels))).where("held_out")
    rows = [(r.score, r.toxic) for r in found.join(labels.where("toxic IS NOT NULL"), "doc_id").collect()]
    assert auc(rows) >= 0.85 and sum(r[1] for r in rows) >= 5


def auc(rows):
    """The probability that a row of label 1 has a higher score than one of label 0."""
    ones, zeros = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_toxicity_rows(awkward, empty):
    lexicon = toxicity.Lexicon({" dog": 3.0}, slope=2.0, offset=-3.0)
    rows = toxicity.score_toxicity(awkward, lexicon).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows) and len(rows) == len(AWKWARD)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert toxicity.score_toxicity(empty, lexicon).count() == 0


# -- 8: decontamination


def brute_contamination(docs, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {}
    for item, text in items:
        ws = find(text)
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            phrases.setdefault(tuple(ws[k : k + window]), set()).add(str(item))
    out = []
    for _, text in docs:
        ws, hit, found = find(text), set(), set()
        for p, who in phrases.items():
            for k in range(len(ws) - len(p) + 1):
                if tuple(ws[k : k + len(p)]) == p:
                    found |= who
                    hit.update(range(k, k + len(p)))
        out.append((len(ws), len(hit), sorted(found)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(7)
    letters = ["a", "b", "C", "d!", "é"]
    text = lambda n: " ".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    for _ in range(150):
        docs, items = [(i, text(60)) for i in range(10)], [(i, text(20)) for i in range(4)]
        phrases, lists = decontaminate.Phrases.of(items), [decontaminate.words_of(t) for _, t in docs]
        spans, found = decontaminate.search_shard(lists, phrases)
        assert [(len(w), sum(b - a for a, b in s), sorted(f)) for w, s, f in zip(lists, spans, found, strict=True)] == brute_contamination(docs, items)


def test_contamination_rows(spark, awkward, empty):
    items = spark.createDataFrame([("i1", "the dog"), ("i1", "the dog"), ("i2", None), (None, "cat"), ("i3", "")], "item_id string, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(awkward, items).collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].item_ids, rows[1].contaminated) == (4, 2, ["i1"], True)
    assert [(s.start, s.end) for s in rows[1].spans] == [(9, 16)] and not rows[2].contaminated
    assert decontaminate.contamination(empty, items).count() == 0
    kept = decontaminate.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 2
    assert decontaminate.drop_contaminated(awkward, items.limit(0)).count() == len(AWKWARD)
    digest = decontaminate.digest(decontaminate.contamination(awkward, items)).where("doc_id = 3").first()
    assert digest.items_sha256 == hashlib.sha256(b"").hexdigest()


def test_a_benchmark_in_parts_and_texts_beyond_a_shard(spark):
    """Parts of a benchmark, long texts in pieces and all at once give the same rows, which brute force gives too."""
    rng = random.Random(16)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "d!", "é", "ff", "g"]) for _ in range(rng.randrange(n)))
    docs, items = [(i, text(400)) for i in range(40)], [(i, text(30)) for i in range(60)]
    want = brute_contamination(docs, items)
    for options in ({}, {"part_bytes": 300, "shard_words": 50}, {"shard_words": 20}):
        found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), **options)
        got = {r.doc_id: r for r in found.collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i].item_ids) for i, _ in docs] == want
        for i, t in docs:
            assert sum(len(decontaminate.words_of(t[s.start : s.end])) for s in got[i].spans) == got[i].n_hit
    clean = {i for i, (n, hit, _) in zip(range(40), want, strict=True) if not (hit > 0 and 20 * hit >= n)}
    clash = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("__hash", "__digest", "digest", "gone", "hits", "item_ids", "n", "asking")})
    for options in ({}, {"part_bytes": 300}):
        kept = decontaminate.drop_contaminated(clash, spark.createDataFrame(items, "item_id int, text string"), **options)
        assert {r.doc_id for r in kept.collect()} == clean and kept.columns == clash.columns


def test_parts_of_a_benchmark_do_not_live_together(spark, monkeypatch):
    rng = random.Random(17)
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    items = [(i, text(20)) for i in range(30)]
    docs = [(i, f"{text(30)} {items[i % 30][1] if i % 3 else ''} {text(5)}") for i in range(60)] + [(100 + i, items[0][1]) for i in range(400)] + [(None, None), (7, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    whole = decontaminate.contamination(df, bench)
    assert len(list(decontaminate.benchmark_parts(bench, 350))) >= 5
    rows = lambda found: Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), tuple(map(tuple, r.spans)), r.contaminated) for r in found.collect())
    for limit in (10**6, 0):  # all hits broadcast, or only those of hot texts
        monkeypatch.setattr(decontaminate, "SENT_TEXTS", limit)
        parts = decontaminate.contamination(df, bench, part_bytes=350)
        assert parts._jdf.queryExecution().toString().split("Physical Plan")[1].count("MapInArrow") == 1
        assert rows(parts) == rows(whole)


# -- 3: lines


def test_line_spread(spark, awkward, empty):
    rows = [(i, f"own {i}\n menu \nown too {i}", f"s{i % 9}") for i in range(18)] + [(50 + i, f"few\nx{i}", f"s{i % 7}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in linedup.remove_boilerplate(docs, min_sites=8).collect()}
    assert got[0].text == rows[0][1] and got[5].text == "own 5\nown too 5" and got[5]["__n_removed"] == 1
    assert got[60].text == rows[28][1]  # seven sites only
    same = linedup.remove_boilerplate(awkward)
    assert same.count() == len(AWKWARD) and same.where("doc_id = 2").first()["__n_lines"] == 0
    assert linedup.remove_boilerplate(empty).count() == 0


# -- 9: licences


def test_licences_are_inherited(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/y.py", None), ("a/z.py", "Licensed under the Apache License, Version 2.0.\ncode code code code"), ("top.py", "free of any license worries"), (None, "All rights reserved."), ("a/b/x.py", "code")]
    got = {(r.path, r.status): r for r in licences.scan_licences(spark.createDataFrame(files, "path string, text string").withColumn("licence", F.lit("clash"))).collect()}
    assert got["a/b/x.py", "inherited"].licence == "MIT" and got["a/b/c/d/y.py", "inherited"].licence == "GPL-3.0"
    assert got["a/z.py", "own"].licence == "Apache-2.0" and got["top.py", "none"].licence is None and got[None, "own"].licence == "Proprietary"
    assert licences.scan_licences(spark.createDataFrame([], "path string, text string")).count() == 0


def brute_best(texts, line):
    """Licence and cosine of the best template for *line*, with document frequencies of every term over *texts*."""
    find = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    df = Counter(w for t in texts for w in set(find(t)))
    vector = lambda t: {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in Counter(find(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    v, best = vector(line), (0.0, None)
    for name, text in licences.TEMPLATES:
        t = vector(text)
        score = round(sum(v[w] * t.get(w, 0) for w in v) / ((norm(v) * norm(t)) or 1), 6)
        best = max(best, (score, name), key=lambda b: b[0])
    return best


def test_every_term_has_its_document_frequency(spark, monkeypatch):
    """Common words beside a notice weigh little, whether the terms are sent to the tasks or joined."""
    notice = "Our project here is licensed under the Apache License, Version 2.0."
    files = [(f"d{i}/x", f"our project here is word{i}") for i in range(3000)] + [("n/x", notice), ("m/x", None)]
    want = brute_best([t for _, t in files], notice)
    assert want[1] == "Apache-2.0" and want[0] >= licences.LEAST
    docs = spark.createDataFrame(files, "path string, text string")
    for sent in (500_000, 0):
        monkeypatch.setattr(licences, "SENT_TERMS", sent, raising=False)
        assert [(r.path, r.licence, r.score) for r in licences.notices(docs).collect()] == [("n/x", want[1], want[0])]


def test_statements_without_common_phrases_are_compared(spark):
    """Every statement is a notice that brute force says is one, whatever words it lacks."""
    rng = random.Random(10)
    parts = [re.findall("[A-Za-z0-9]+", t) for _, t in licences.TEMPLATES]
    lines = ["Available under CC BY-NC 4.0", "Published under CC BY 4.0", "Dedicated under CC0 1.0"]
    lines += [" ".join(rng.sample(p, rng.randrange(1, len(p) + 1)) + [f"w{rng.randrange(9)}" for _ in range(rng.randrange(4))]) for p in parts for _ in range(20)]
    files = [(f"d{i}/x", t) for i, t in enumerate(lines)] + [(f"e{i}/x", "the work of all in any form is this code") for i in range(1000)]
    want = {p: brute_best([t for _, t in files], t) for p, t in files[: len(lines)]}
    got = {r.path: (r.score, r.licence) for r in licences.notices(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {p: b for p, b in want.items() if b[0] >= licences.LEAST} and "d0/x" in got


# -- 1: quality


def test_quality(spark, awkward, empty):
    rng = random.Random(8)
    good = [(i, words(rng, 50, 5000), "en", f"s{i % 5}", 300) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w.upper()}!!!" for w in words(rng, 40).split()), "en", f"s{i % 5}", 200) for i in range(80)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good[:150] + junk[:40]] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert all(r.keep == (r.doc_id < 1000) for r in rows) and sum(model.rounds) > 0
    assert quality.reject(docs, model).count() == 300
    assert quality.score_quality(awkward, model).count() == len(AWKWARD) and quality.reject(empty, model).count() == 0
    untrained = quality.fit(awkward, labels.limit(0))
    assert quality.reject(awkward, untrained).count() == len(AWKWARD)


def test_pseudo_labels_come_from_the_whole_table(spark):
    """The bound is on the rows handed over in a round, not on the rows that they are chosen from."""
    rng = random.Random(11)
    good = [(i, words(rng, 50, 5000), "en", f"s{i % 5}", 300) for i in range(120)]
    junk = [(1000 + i, " ".join(f"{w.upper()}!!!" for w in words(rng, 40).split()), "en", f"s{i % 5}", 200) for i in range(60)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good[:60] + junk[:30]], "doc_id long, quality int")
    assert sum(quality.fit(docs, labels, pool_rows=1).rounds) > 2


def test_quality_on_held_out_labels(spark):
    """Fitted on two thirds of the labels at sf0.01, scored on the others: both views together, and the text alone."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.where("quality IS NOT NULL").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    found = quality.score_quality(docs, quality.fit(docs, labels.where("NOT held"))).join(labels.where("held"), "doc_id").collect()
    assert auc([(r.score, r.quality) for r in found]) >= 0.97 and auc([(r.text_score, r.quality) for r in found]) >= 0.97
    print("auc", auc([(r.score, r.quality) for r in found]), auc([(r.text_score, r.quality) for r in found]), auc([(r.meta_score, r.quality) for r in found]), len(found))


# -- 10: near duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        ws = (text or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "block"), [(2, 256), (5, 256), (2, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, size, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "ASKING", min(block, 4))
    rng, rows = random.Random(9), []
    for g in range(12):
        base = words(rng, 120, 10**5).split()
        for k in range(rng.choice([1, 2, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            rows.append((g * 100 + k, " ".join(copy)))
    rows += [(5000, "one"), (5001, "ONE "), (5002, None), (5003, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rows_of_a_hot_bucket_all_meet(spark, monkeypatch):
    """Unmet classes of a bucket meet pairwise, and everyone of them meets every member of a component there."""
    from lexforge.session import Scratch

    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "ASKING", 2)
    cand = spark.createDataFrame([(7, i, i, 0, 0) for i in range(60)], "key long, id long, body long, head long, head_body long")
    comps = spark.createDataFrame([(i, i % 2) for i in range(30)], "id long, comp long")
    tasks = {}
    for r in neardup._rest_places(cand, comps, Scratch(spark)).collect():
        tasks.setdefault((r.kind, r.g, r.block, r.part), ([], []))[r.role].append((r.id, r.comp))
    met = [frozenset((a, b)) for held, asks in tasks.values() for a, ca in held for b, cb in asks if ca != cb]
    assert set(met) == {frozenset((a, b)) for a in range(60) for b in range(a) if a >= 30 or (a + b) % 2}


def test_rows_that_share_an_id_are_linked(spark):
    """Through a document of two unlike texts their copies are one component."""
    a, b, c = (words(random.Random(k), 40) for k in (20, 21, 22))
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (2**53 + 1, b), (2**53, c), (None, b)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 9, True), (2**53 + 1, 1, False), (2**53, 9, False), (None, None, False)])


def test_rows_of_hot_keys_meet_all_the_same(spark, monkeypatch):
    """With every key hot, and with none, the components are those of brute force."""
    from lexforge.llm import common

    rng, rows = random.Random(23), []
    base = words(rng, 120, 10**5).split()
    for k in range(40):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (0, 10**6):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        got = neardup.near_duplicates(docs).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5, 80)


def test_near_duplicates_of_a_whole_table(spark):
    """Sets and components of all documents at sf0.001, by brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = neardup.op10_minhash_near_duplicates(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 2, 80)


def test_components_of_a_long_chain(spark):
    from lexforge.session import Scratch

    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(900, 800)], "u long, v long")
    got = {r.id: r.comp for r in neardup.components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(201)} | {800: 800, 900: 800}


def test_near_duplicates_awkward(awkward, empty):
    rows = neardup.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r.component_id is None and not r.kept for r in rows if r.doc_id is None)
    left = neardup.deduplicate(awkward)
    assert left.columns == awkward.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicate(empty).count() == 0
