"""Records and streams: killed batches, rotated logs, changed lists, changed documents."""

import gzip

import pytest
from pyspark.sql import functions as F

from lexforge.operators import changes, terms
from lexforge.sources import corpus
from lexforge.streaming import RECORD, CurrentList, checked_stream, read_record, record_days, record_stream


def days(spark, *rows):
    return spark.createDataFrame([(d, u, b, day) for day, d, u, b in rows], RECORD)


def test_a_killed_batch_given_again_leaves_one_row_a_day(spark, tmp_path):
    path = str(tmp_path / "record")
    first = days(spark, ("2024-01-01", 5, 3, 1), ("2024-01-02", 7, 4, 0))

    class Killed(Exception):
        pass

    # Killed between the check and the write: a second writer has recorded the same days meanwhile.
    checked = first.join(read_record(spark, path).select("day").distinct(), "day", "left_anti").select(*first.columns).cache()
    checked.count()
    record_days(first, path)
    record_days(checked, path)
    with pytest.raises(Killed):
        for row in [days(spark, ("2024-01-03", 1, 1, 0))]:
            record_days(row, path)
            raise Killed
    record_days(days(spark, ("2024-01-03", 1, 1, 0), ("2024-01-02", 99, 99, 99)), path)
    assert sorted((r.day, r.downloads, r.unique, r.bots) for r in read_record(spark, path).collect()) == [("2024-01-01", 5, 3, 1), ("2024-01-02", 7, 4, 0), ("2024-01-03", 1, 1, 0)]


def test_files_of_a_day_that_a_killed_writer_left_are_replaced(spark, tmp_path):
    path = str(tmp_path / "record")
    row = days(spark, ("2024-01-01", 5, 3, 1))
    stale = row.cache()
    stale.count()
    for _ in range(2):  # both passed the check before either wrote
        stale.withColumn("of_day", F.col("day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of_day").parquet(path)
    assert read_record(spark, path).count() == 1


def test_a_stream_records_each_day_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "record")
    days(spark, ("2024-01-01", 5, 3, 1)).write.parquet(source)
    for checkpoint in ("one", "two", "two"):  # a lost checkpoint gives all batches again
        stream = spark.readStream.schema(RECORD).parquet(source)
        record_stream(stream, path, str(tmp_path / checkpoint)).awaitTermination()
    assert [tuple(r) for r in read_record(spark, path).select("day", "downloads").collect()] == [("2024-01-01", 5)]


def test_the_list_is_looked_for_between_batches_and_kept_on_failure(spark):
    now, found, asked = [0.0], [("v1", [("a",)])], []

    def load(version):
        asked.append(version)
        if found[0] is None:
            raise OSError("gone")
        name, rows = found[0]
        return name, None if name == version else spark.createDataFrame(rows, "key string")

    listed = CurrentList(load, seconds=600, clock=lambda: now[0])
    assert listed.get().count() == 1 and len(asked) == 1
    found[0] = ("v2", [("a",), ("b",)])
    assert listed.get().count() == 1 and len(asked) == 1  # too early to look again
    now[0] = 600
    assert listed.get().count() == 2 and listed.version == "v2"
    found[0], now[0] = None, 1200
    assert listed.get().count() == 2 and listed.stale
    found[0], now[0] = ("v2", []), 1800
    assert listed.get().count() == 2 and not listed.stale
    with pytest.raises(OSError):
        CurrentList(lambda _: (_ for _ in ()).throw(OSError("never there"))).get()


def test_batches_are_checked_against_the_list_of_their_time(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    version = ["v1"]
    listed = CurrentList(lambda _: (version[0], spark.createDataFrame([("a",)] if version[0] == "v1" else [("a",), ("b",)], "key string")), seconds=0)
    check = lambda refs, rows: refs.join(rows.withColumn("hit", F.lit(1)), "key", "left").select("key", F.coalesce("hit", F.lit(0)).alias("hit"))
    for name in ("v1", "v2"):
        version[0] = name
        spark.createDataFrame([("b",)], "key string").coalesce(1).write.mode("append").parquet(source)
        checked_stream(spark.readStream.schema("key string").parquet(source), listed, check, path, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.list, r.hit) for r in spark.read.parquet(path).collect()) == [("v1", 0), ("v2", 1)]


def test_generations_of_a_log_and_no_other_file(spark, tmp_path):
    (tmp_path / "tier1.log").write_text("a\nb\n")
    (tmp_path / "tier1.log.1").write_text("c\n")
    (tmp_path / "tier1.log-20240101.gz").write_bytes(gzip.compress(b"d\ne\n"))
    (tmp_path / "tier2.log").write_text("x\n")
    assert sorted(r[0] for r in corpus.rotated_logs(spark, str(tmp_path), "tier1.log").collect()) == list("abcde")


def test_delta_files_are_pruned_by_their_path(spark, tmp_path):
    for name in ("bger", "delta-bger", "delt", "d", "deltaX"):
        spark.createDataFrame([(name,)], "decision_id string").coalesce(1).toPandas().to_parquet(tmp_path / f"{name}.parquet")
    rows = corpus.court_files(spark, str(tmp_path))
    assert sorted(r.decision_id for r in rows.collect()) == ["bger", "d", "delt", "deltaX"] and "delta-bger" not in str(rows.inputFiles())


def test_a_record_of_two_forms(spark):
    lines = ["day\tdownloads\tunique", "2024-01-01\t5\t3", "2024-01-02\t7\t4", "day\tdownloads\tunique\tbots", "2024-01-02\t7\t4\t2", "", "x\t1", "2024-01-03\t\t1", "2024-01-04\t9\t8\t7\r"]
    rows = corpus.record_rows(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(map(tuple, rows.collect())) == [("2024-01-01", 5, 3, None), ("2024-01-02", 7, 4, 2), ("2024-01-04", 9, 8, 7)]


def test_moved_repeated_and_dropped_parts(spark):
    before = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("d", 4, None), ("d", 5, "e"), ("d", 6, "e"), ("same", 1, "x"), ("same", 2, "x")], "doc string, part int, text string")
    after = spark.createDataFrame([("d", 1, "b"), ("d", 2, "b"), ("d", 9, "c"), ("d", 4, ""), ("d", 5, "new"), ("d", 6, "e"), ("same", 2, "x"), ("same", 1, "x")], "doc string, part int, text string")
    assert sorted((r.kind, r.n_before, r.n_after) for r in changes.changes(before, after).collect()) == [("added", 0, 1), ("dropped", 1, 0), ("moved", 1, 1), ("repeated", 1, 2), ("thinned", 2, 1)]
    assert [tuple(r) for r in changes.to_check(before, after).collect()] == [("d", 5, "new")]
    assert changes.changes(after, after).count() == 0


def test_what_a_copy_still_shows(spark):
    copy = spark.createDataFrame([(1, "Hans A.________ und H. B.________ sowie C.________ Muster, Muster & Söhne."), (2, "A.________ ruft."), (3, None)], "id long, text string")
    forms = spark.createDataFrame([(0, "Muster & Söhne")], "term_id long, term string")
    assert sorted(map(tuple, changes.left_in_copy(copy, forms).collect())) == [(1, "form", "Muster & Söhne", 1), (1, "half", "H.", 1), (1, "half", "Hans", 1), (1, "half", "Muster", 1)]


def test_terms_and_what_only_looks_like_them(spark):
    texts = [(1, "In St.Gallen und st. gallen, nicht St Gallen."), (2, "Müller-Meier, MÜLLER  MEIER; Müllermeier, xMüller Meier, Müller Meier_"), (3, "a.b. A. B. a.b"), (4, None), (5, "Bau AG Bau-AG BauAG")]
    own = [(0, "St. Gallen"), (1, "Müller Meier"), (2, "A.B."), (3, " - "), (4, "bau ag"), (5, "BAU-AG")]
    df, tf = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(own, "term_id long, term string")
    raw = dict(texts)
    found = sorted((r.id, r.start, r.term_id, raw[r.id][r.start : r.end]) for r in terms.find_terms(df, tf).collect())
    assert sorted((i, t, x) for i, _, t, x in found) == sorted([(1, 0, "St.Gallen"), (1, 0, "st. gallen"), (2, 1, "MÜLLER  MEIER"), (2, 1, "Müller-Meier"), (3, 2, "A. B."), (3, 2, "a.b."), (5, 4, "Bau AG"), (5, 4, "Bau-AG")])
    assert terms.find_terms(df, tf.limit(0)).count() == 0
    shown = spark.createDataFrame([(1, 7, 3, 12), (1, 8, 17, 40)], "id long, row long, start int, end int")
    kept = terms.choose(terms.find_terms(df.where("id = 1"), tf), shown).collect()
    assert sorted((r.source, r.row, r.start) for r in kept) == [(0, 0, 3), (1, 8, 17)]
