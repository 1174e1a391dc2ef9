"""Values that several steps look at are computed once, tasks are many enough, and spans move once."""

import pytest
from pyspark.sql import functions as F

import sparklines.plans.catalog_jobs  # noqa: F401 (registers its queries)
from sparklines.functions import values
from sparklines.operators.segments import segment_spans
from sparklines.plans import catalog
from sparklines.plans.catalog import QUERIES
from sparklines.sources import dlt

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("name", "part", "most"), [("search_spans", "from_json(", 3), ("dlt_binary", "timestamp_seconds(", 2)])
def test_parsed_once(spark, name, part, most):
    text = plan(QUERIES[name](spark, DATA))
    assert text.count(part) == most


def test_small_contents_share_batches():
    message = bytes.fromhex("444C5401FFFFFF7F") + bytes(4) + b"ECU1" + bytes.fromhex("2107001A4105") + b"APP1CTX1" + bytes(12)
    batches = list(dlt._batches((str(i), 0, dlt.frames(message)) for i in range(300)))
    assert [b.num_rows for b in batches] == [300]


def test_spans_move_once_and_the_query_not_at_all(spark):
    df = spark.createDataFrame([("a", 0, 0, 5, 1, "x", None), ("a", 0, 2, 8, 2, None, "q"), ("a", 0, 3, 3, 9, "z", "z"), ("a", 0, 8, 9, 0, None, "q")], "src string, line_idx long, s int, e int, priority int, a string, b string")
    got = segment_spans(df)
    assert sorted(tuple(r)[2:] for r in got.collect()) == [(0, 2, "x", None), (2, 5, "x", "q"), (5, 9, None, "q")]
    assert "Join" not in plan(got) and "Window" not in plan(got)
    assert "Aggregate" not in plan(QUERIES["overlay_segments"](spark, DATA))


def test_overlaps_are_settled_on_spans_found_once(spark):
    df = spark.createDataFrame([("GET /a 200 10.0.0.1",)], "raw string").select(values.value_spans(F.col("raw")).alias("v"))
    assert plan(df).count("status_") == 2  # the class itself and the one switched off
    assert [r.tag for r in df.collect()[0].v] == ["http_get", "status_2xx", "ip_address"]


def test_tasks_grow_in_number_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PART", 1 << 10)
    df = catalog._spread(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    assert df.rdd.getNumPartitions() > 100
