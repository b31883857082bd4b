"""Examples of single operators, with invented people and decisions."""

import datetime

from pyspark.sql import functions as F

from lexforge.functions import dates, keys
from lexforge.operators import citelist, evaluation, identifiers, references, rollup, vocabulary
from lexforge.sources import corpus, sinks
from lexforge.streaming import daily_stream, record_stream


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_docket_keys(spark):
    cases = {"4A 747/2012": "4A_747/2012", "4C.230/2006": "4C_230/2006", "ZK1  2023 26": "ZK1 2023 26", "HC / 2018 / 391": "HC/2018/391", "4a 7/2012": "4A_7/2012", " ": "", "2C_1‑2/2000": "2C_1-2/2000"}
    for written, key in cases.items():
        assert one(spark, keys.docket_key(F.lit(written))) == key


def test_collection_keys(spark):
    assert one(spark, keys.collection_key(F.lit(99), F.lit("Ia"), F.lit(5))) == "BGE 099 IA 0005"
    assert one(spark, keys.collection_key(F.lit(99), F.lit("VI"), F.lit(5))) is None
    assert one(spark, keys.key_for(F.lit("bge"), F.lit("73_II_6"))) == "BGE 073 II 0006"
    assert one(spark, keys.key_for(F.lit("bger"), F.lit("#1"))) is None
    assert one(spark, keys.label(F.lit("BGE 099 IA 0005"))) == "BGE 99 Ia 5"


def test_natural_order(spark):
    assert one(spark, keys.natural_sorted(F.array(*map(F.lit, ["10", "5", "4.10", "4.2", "2a", "5"])))) == ["2a", "4.2", "4.10", "5", "10"]


def test_dates(spark):
    assert one(spark, dates.iso(dates.parts(F.lit("vom 3. März 2014")))) == "2014-03-03"
    assert one(spark, dates.iso(dates.parts(F.lit("du 1er août 2001")))) == "2001-08-01"
    assert one(spark, dates.iso(dates.parts(F.lit("31. Februar 2013")))) is None
    assert one(spark, dates.impossible(dates.parts(F.lit("31. Februar 2013")))) == "2013-02-31"
    assert one(spark, dates.iso(dates.parts(F.lit("no date")))) is None


def test_one_edit_variants(spark):
    got = set(one(spark, citelist.one_edit_away(F.lit("4A_12"))))
    assert {"5A_12", "4B_12", "4A_2", "4A_21", "4A_123", "A4_12", "4AB_12"} <= got
    assert "4A-12" not in got and "4A_12" not in got


def test_check_statuses(spark):
    rows = spark.createDataFrame([("4A_1/2010", "bger", "CH", "2010-03-03", ["1", "2.1"], "d1"), ("4A_1/2010", "zh_obergericht", "ZH", "2010-01-01", [], "d2")], "key string, court string, canton string, date string, enums array<string>, id string")
    prose = [(1, "Urteil 4A_1/2010 vom 3. März 2010 E. 2.1"), (2, "Urteil 4A_1/2010 vom 3. März 2010 E. 7"), (3, "Urteil 4A_9/2010"), (4, "Urteil des Bundesverwaltungsgerichts 4A_1/2010"), (5, "kein Zitat"), (6, "Urteil des Bundesgerichts 4A_1/2010 vom 4. März 2010")]
    found = {r.ref_id: r for r in references.check(references.parsed(spark.createDataFrame(prose, "ref_id long, prose string")), rows).collect()}
    assert [found[i].status for i in range(1, 7)] == ["found", "differs", "missing", "differs", "unchecked", "differs"]
    assert found[2].issues == ["pinpoint"] and found[4].issues == ["court"] and found[6].issues == ["date"]


def test_continued_labels_and_ranges(spark):
    assert one(spark, references.continued(F.lit("BGE 140 III 115; 141 II 3 und 142 I 9"))) == ["BGE 140 III 115", "BGE 141 II 3", "BGE 142 I 9"]
    assert one(spark, references.pinpoints(F.lit("E. 2.3 und 2.4"))) == ["2.3", "2.4"]


def test_identifiers():
    found = {s["label"]: s for s in identifiers.scan("Frau X, wohnhaft Musterweg 12, AHV 756.9217.0769.85, anna@gmail.com, IBAN CH93 0076 2011 6238 5295 7. Die Kasse: info@kasse.admin.ch")}
    assert found["social_insurance"]["value"] == "756.9217.0769.85"
    assert found["iban"]["value"].startswith("CH93") and found["address"]["value"] == "Musterweg 12"
    assert [s["status"] for s in identifiers.scan("anna@gmail.com und info@kasse.admin.ch")] == ["shown", "public"]
    assert identifiers.scan("756.9217.0769.84") == [] and identifiers.scan("") == []


def test_people():
    known, unsure = identifiers.resolve_people([(0, "Hans Muster", None), (20, "Muster", None), (40, "Anna Muster", None), (60, "Beispiel", None), (80, "Beispiels", None)])
    assert [p["name"] for p in known] == ["Hans Muster", "Anna Muster", "Beispiel"]
    assert unsure[0]["name"] == "Muster" and unsure[0]["candidates"] == [0, 1]
    assert known[2]["mentions"] == [60, 80]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "Hans Muster rief an"), (2, "nichts"), (3, None)], "id long, text string")
    spans = spark.createDataFrame([(1, 0, 11, "A.____"), (1, 5, 11, "B")], "id long, start int, end int, label string")
    assert {r.id: r.text for r in identifiers.redact(docs, spans).collect()} == {1: "A.____ rief an", 2: "nichts", 3: None}


def test_compounds(spark):
    lexicon = spark.createDataFrame([("wein",), ("flasche",), ("regal",)], "word string")
    words = spark.createDataFrame([("weinflasche",), ("weinflaschenregal",), ("turmalin",)], "word string")
    assert {r.word for r in vocabulary.compounds(words, lexicon).collect()} == {"weinflasche", "weinflaschenregal"}


def test_hit_rates_and_quantiles(spark):
    counts = spark.createDataFrame([("de", n) for n in (0, 1, 2, 3, 10)], "lang string, n long")
    row = evaluation.lengths(counts).first()
    assert (row.documents, row.median, row.p90, row.none) == (5, 2.0, 3, 0.2)


def test_log_rules(spark):
    lines = ['1.1.1.1 2024-05-01T00:00:01 "GET /f?x=1" 200 0.1 "Mozilla"', '1.1.1.2 2024-05-01T00:00:02 "GET /f" 304 0.1 "Googlebot/2"', '1.1.1.3 2024-05-01T00:00:03 "HEAD /f" 200 0.1 "x"', '1.1.1.4 2024-05-03T00:00:03 "GET /f" 404 0.1 "x"', '1.1.1.5 2024-05-03T01:00:03 "GET /f" 200 0.1 "x"', "noise"]
    rows = rollup.admitted(rollup.log_rows(spark.createDataFrame([(x,) for x in lines], "value string")), "/f").withColumn("bot", rollup.is_bot(F.col("agent")))
    days = {r.day: (r.downloads, r.unique, r.bots) for r in rollup.with_zero_days(rollup.daily(rows), rows).collect()}
    assert days == {"2024-05-01": (1, 1, 1), "2024-05-02": (0, 0, 0), "2024-05-03": (1, 1, 0)}


def test_stream_equals_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    data = [(base + datetime.timedelta(hours=5 * i), f"a{i % 7}", i % 4 == 0) for i in range(60)]
    schema = "at timestamp, addr string, bot boolean"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds its checkpoint and adds nothing
        record_stream(daily_stream(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.day: (r.downloads, r.unique, r.bots) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = rollup.daily(spark.createDataFrame(data, schema).withColumn("day", F.date_format("at", "yyyy-MM-dd")))
    want = {r.day: (r.downloads, r.unique, r.bots) for r in batch.collect()}
    assert got and all(want[d] == v for d, v in got.items()) and len(got) >= len(want) - 3


def test_neighbours_over_ranges_without_keys(spark):
    import bisect

    from lexforge.operators import citelist

    listed = [f"K{i:03d}" for i in range(300, 340)] + ["Z9"]
    asked = [f"K{i:03d}" for i in range(0, 900, 3)] + ["A", "Z9", "ZZ"]
    got = citelist.neighbours(spark.createDataFrame([(p,) for p in asked], "probe string"), spark.createDataFrame([(k,) for k in listed], "key string")).collect()
    at = {p: (bisect.bisect_left(listed, p), bisect.bisect_right(listed, p)) for p in asked}
    assert {r.probe: (r.before, r.after) for r in got} == {p: (listed[a - 1] if a else None, listed[b] if b < len(listed) else None) for p, (a, b) in at.items()}
    assert len(got) == len(asked)


def test_trials(spark):
    docs = spark.createDataFrame([(1, "Der Kläger A.________ und die Beklagte B.________ sind sich einig."), (2, "niemand"), (3, "A.________")], "id long, text string")
    got = [tuple(r) for r in evaluation.mask_positions(docs, head=0, tail=0).orderBy("id", "start").collect()]
    assert got == [(1, 0, 11, 21, "A.________"), (1, 1, 39, 49, "B.________")]
    assert [(r.start, r.end) for r in evaluation.mask_positions(docs, head=-1, tail=0).where("id = 3").collect()] == [(0, 10)]
    assert one(spark, evaluation.spliced(F.lit("abcdef"), F.lit(2), F.lit(4), F.lit("X"))) == "abXef"
    assert [one(spark, evaluation.percent(F.lit(a), F.lit(b))) for a, b in ((1234, 1256), (0, 0))] == ["98.2 % (1,234/1,256)", "n/a"]


def test_made_up_identifiers_are_valid_and_shown(spark):
    docs = spark.range(1, 40).select("id", F.lit("Im Verfahren von A.________ gegen B.________ wurde entschieden.").alias("text"))
    cases = evaluation.identifier_cases(docs)
    assert cases.where("label = 'ahv'").where(~identifiers.social_insurance_valid(F.col("phrase"))).count() == 0
    assert cases.where("label = 'iban'").where(~identifiers.iban_valid(F.substring("phrase", 6, 40))).count() == 0
    first = evaluation.mask_positions(docs, head=-1, tail=0).where("nth = 0")
    got = {r.label: (r.n, r.hits) for r in evaluation.identifier_recall(docs, first).collect()}
    assert got == {k: (39, 39) for k in ("ahv", "iban", "mobile", "address", "plate", "parcel", "birth_date")}


def test_parcels_and_numbers_in_any_case():
    for text, value in (("Parzelle Nr. 1234,", "1234"), ("auf Parz. 77 und", "77"), ("Kat.-Nr. 1'204.", "1'204"), ("la parcelle n° 12", "12"), ("PARZELLE NR. 5", "5")):
        assert [(s["label"], s["value"]) for s in identifiers.scan(text)] == [("parcel", value)]
    assert identifiers.scan("die Parzelle liegt an der Grenze") == []


def test_collection_suggestions(spark):
    lines = [("BGE 140 III 0100", "bge"), ("BGE 140 III 0150", "bge"), ("BGE 140 II 0115", "bge"), ("BGE 140 II 0115", "x"), ("BGE 141 III 0115", "bge"), ("BGE 140 III 0151", "bge"), ("BGE 041 III 0115", "bge")]
    rows = spark.createDataFrame([(k, c, "CH", "2014-01-01") for k, c in lines], "key string, court string, canton string, date string")
    refs = spark.createDataFrame([(1, "BGE 140 III 0115"), (2, "BGE 140 III 0115"), (3, "BGE 140 III 0190"), (4, "BGE 140 III 0192"), (5, "1A_1/2000")], "ref_id long, key string")
    got = [tuple(r) for r in citelist.collection_suggestions(refs, rows).select("ref_id", "key", "court", "reason").orderBy("ref_id", "rank").collect()]
    first = [("BGE 140 III 0100", "bge", "contains_page"), ("BGE 140 II 0115", "bge", "other_part"), ("BGE 140 II 0115", "x", "other_part"), ("BGE 140 III 0151", "bge", "one_character")]
    assert [g[1:] for g in got if g[0] == 1] == [g[1:] for g in got if g[0] == 2]
    assert [g[1:] for g in got if g[0] == 1][:3] == first[:3] and len([g for g in got if g[0] == 1]) == 4
    assert [g[1:] for g in got if g[0] == 3][0] == ("BGE 140 III 0151", "bge", "contains_page")
    assert not [g for g in got if g[0] == 4 and g[3] == "contains_page"] and not [g for g in got if g[0] == 5]


def test_kept_tables_and_replaced_files(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    assert sinks.kept(spark.range(3), path).count() == 3 and sinks.kept(spark.range(9), path).count() == 3
    for text in (b"old", b"new"):
        sinks.write_bytes(spark, f"file://{tmp_path}/f.txt", text)
    assert (tmp_path / "f.txt").read_bytes() == b"new" and not (tmp_path / "f.txt.tmp").exists()
    (tmp_path / "p.txt").write_bytes(b"a\r\n\nb\n")
    assert [(r.paragraph, r.text) for r in corpus.text_lines(spark, f"file://{tmp_path}/p.txt").orderBy("paragraph").collect()] == [(0, "a"), (1, ""), (2, "b")]


def test_words_are_summed_up_in_the_tasks(spark):
    """What is dealt out are sums by word and court, not words; rows of one id are one document, numbers are no letters."""
    from lexforge.operators import vocabulary as v

    docs = spark.createDataFrame([(1, "a", "Herr Muster kam. Anna Muster kam x²y ab²cd"), (1, "a", "MUSTER"), (2, "b", "muster Anna  Muster Dr.\nMuster"), (None, None, "kam"), (None, None, "kam")] + [(9, "c", "kam kam")] * 50, "id long, court string, text string")
    told = v._told(docs.where("id = 9").coalesce(1).withColumn("id", F.lit(None).cast("string")))
    assert [(r.word, r.docs, r.low) for r in told.collect()] == [("kam", 50, 100)]
    got = {r.word: tuple(r)[1:] for r in v.word_statistics(docs, spark.createDataFrame([("anna",)], "name string")).collect()}
    assert got["muster"] == (2, 2, 5, 1, 1, 2, 1) and got["kam"] == (3, 2, 0, 104, 0, 0, 0) and got["ab"] == (1, 1, 0, 1, 0, 0, 0) and "ab²cd" not in got


def test_pairs_of_joined_applications_are_dealt_to_many_tasks(spark):
    numbers = spark.range(0, 20_000, numPartitions=1)
    listed = numbers.select(F.concat((F.col("id") % 100).cast("string"), F.lit("/20_"), F.col("id").cast("string"), F.lit("/20")).alias("key"))
    references = numbers.select(F.col("id").alias("ref_id"), F.concat((F.col("id") % 200).cast("string"), F.lit("/20")).alias("key"))
    found = citelist.joined_applications(references, listed)
    in_tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(in_tasks) == 10_000 * 200 and max(in_tasks) < sum(in_tasks) / 4 and len(in_tasks) > 16


def test_pairs_of_a_lookup_are_dealt_to_many_tasks_in_lists_of_bounded_length(spark):
    numbers = spark.range(0, 6_000, numPartitions=1)
    key = lambda n: F.concat(F.lit("1A_"), (F.col("id") % n).cast("string"), F.lit("/1995"))
    references = numbers.select(F.when(F.col("id") > 5, F.col("id")).alias("ref_id"), F.when(F.col("id") % 7 > 0, key(60)).alias("key"), F.lit("x").alias("more"))
    hot = spark.range(3 * citelist.GATHERED).select("id", F.lit("hot").alias("key"), F.lit(None).cast("string").alias("more"))
    references = references.unionByName(hot.withColumnRenamed("id", "ref_id"))
    rows = numbers.select(key(30).alias("key"), F.col("id").alias("line")).unionByName(spark.createDataFrame([("hot", -1), (None, -2)], "key string, line long"))
    lists = citelist.gathered(references, ["key"], "key").select("key", F.size("refs").alias("n")).collect()
    assert max(r.n for r in lists) <= citelist.GATHERED and sum(r.n for r in lists) == references.where("key IS NOT NULL").count()
    found, want = citelist.lookup(references, rows), references.join(rows, "key")
    assert found.schema.simpleString() == want.schema.simpleString() and found.exceptAll(want).count() == want.exceptAll(found).count() == 0
    in_tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(in_tasks) > 12 and max(in_tasks) < sum(in_tasks) / 4


def test_what_lines_cover_tells_the_same_states(spark):
    enums = [[], ["1", "2.1", "3a", "3c/aa", "4.10b"], ["10.2.3", "7bb/cc/d"], ["3"]]
    pins = [None, "", "1", "2", "2.1", "2.1a", "3", "3a", "3b", "3c", "3c/a", "3c/aa", "3c/aa/b", "4", "4.1", "4.10", "10", "10.2", "1a", "7", "7b", "7bb", "7bb/c", "7bb/cc", "77"]
    both = spark.createDataFrame([(e, p) for e in enums for p in pins], "enums array<string>, pin string").withColumn("known", citelist.covered(F.col("enums")))
    state = lambda *known: citelist.pinpoint_state(F.col("pin"), F.col("enums"), *known)
    rows = both.select("enums", "pin", state().alias("plain"), state(F.col("known")).alias("told")).collect()
    assert len(rows) == 100 and all(r.plain == r.told for r in rows) and len({r.plain for r in rows}) == 4
