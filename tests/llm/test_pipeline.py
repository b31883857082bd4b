import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline
    from lexforge.llm import decontaminate, neardup

    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        counts.append(docs.count())
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert 0 < counts[3] <= counts[2] <= counts[1] <= counts[0] < 200
    before_last = spark.read.parquet(str(tmp_path / "3"))
    assert neardup.near_duplicates(before_last).where("NOT kept").count() == 0
    assert decontaminate.contamination(before_last, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count() == 0
    assert docs.select("doc_id").distinct().count() == counts[3]


def test_empty_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_sql_of_operators(spark):
    from lexforge.llm import registry

    for name, sql in registry.oracle_sql().items():
        assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck(sql, SF)), name


def plain_pipeline(docs, items, scores):
    """{doc_id: text} of what the first four stages leave, with the classifier's scores given."""
    from lexforge.llm import linedup, quality
    from tests.llm.test_llm import brute_components

    docs = {i: (text, source) for i, text, source in docs if scores[i] >= quality.KEEP}
    places = {}
    for i, (text, source) in docs.items():
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                places.setdefault(line.strip(" "), []).append((i, pos, source))
    gone = set()
    for found in places.values():
        if len({s for _, _, s in found if s is not None}) >= linedup.MIN_SITES:
            gone |= {p[:2] for p in found} - {min(p[:2] for p in found)}
    left = {}
    for i, (text, _) in docs.items():
        lines = (text or "").split("\n")
        kept = "\n".join(line for pos, line in enumerate(lines) if (i, pos) not in gone)
        if not any((i, pos) in gone for pos in range(len(lines))) or kept.strip(" \n\r\t"):
            left[i] = kept
    left = {i: left[i] for i, (_, first) in brute_components(list(left.items()), 5, 80).items() if i == first}
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases = {tuple(ws[k : k + 13]) for ws in map(find, items) for k in range(max(1, len(ws) - 12) if ws else 0)}
    clean = {}
    for i, text in left.items():
        ws = find(text)
        hit = {j for n in {len(p) for p in phrases} for k in range(len(ws) - n + 1) if tuple(ws[k : k + n]) in phrases for j in range(k, k + n)}
        if not hit or 20 * len(hit) < len(ws):
            clean[i] = text
    return clean


def test_run_equals_a_plain_version(spark, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from lexforge.llm import packing, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").first().text
    rng = random.Random(12)
    prose = [" ".join(f"{rng.choice('bdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.randrange(10**4)}" for _ in range(80)) for _ in range(12)]
    extra = [(900_000 + i, f"the shared menu line\n{t}.", f"site{i}") for i, t in enumerate(prose)] + [(900_100, f"{prose[0]} end.", "site0"), (900_101, f"{prose[5]} {item}", "site1"), (900_102, "the shared menu line", "site2")]
    made = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(made.select(*[F.col(c).cast(docs.schema[c].dataType) for c in docs.columns])).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    read = {n: spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels", "benchmark")}
    model = quality.fit(read["documents"], read["labels"])
    scores = {r.doc_id: r.score for r in quality.score_quality(read["documents"], model).collect()}
    rows_in = [(r.doc_id, r.text, r.source) for r in read["documents"].collect()]
    want = plain_pipeline(rows_in, [r.text for r in read["benchmark"].where("item_id IS NOT NULL").collect()], scores)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r.length)
    assert not {900_100, 900_101, 900_102} & set(want) and set(range(900_000, 900_012)) & set(want)
    assert set(pieces) == set(want) and all(sum(s) <= packing.MAX_TOKENS and len(s) <= packing.MAX_SEGMENTS for s in sequences.values())
    for i, text in want.items():
        ids, at = np.array([*library.encode(text, add_special_tokens=False).ids, packing.SEPARATOR], dtype="<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
