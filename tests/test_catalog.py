"""Every query against its SQL on the smallest tables."""

import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexforge.operators import identifiers
from lexforge.plans import catalog
from tests.compare import duck, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = rows(catalog.queries()[name](spark, SF).toPandas())
    assert got == rows(duck(catalog.oracle_sql()[name], SF))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_identifiers_equal_a_scan_of_every_text(spark):
    """All texts, those too that the query's filter leaves out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, s["label"], s["start"], s["end"], s["value"]) for r in docs for s in identifiers.scan(unicodedata.normalize("NFC", r.text or "")))
    assert sorted((r.id, r.label, r.start, r.end, r.value) for r in catalog.queries()["identifier_scan"](spark, SF).collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["pinpoint_check", "nearby_numbers", "absent_pins"])
def test_answers_are_not_dealt_out_again_before_they_meet_their_references(spark, name):
    """Lines meet lists of references by their key, and these lists are what is laid out, in many tasks."""
    found = catalog.queries()[name](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("inline(refs") < plan.index("Join") and "RepartitionByExpression" in plan
    assert found.groupBy(F.spark_partition_id()).count().count() > 12
