import pytest
from pyspark.sql import functions as F

from sparklines.functions.spans import find_spans
from sparklines.functions.values import value_spans
from sparklines.model import filter_set
from sparklines.operators import profile, project, search
from sparklines.operators.detect import with_parts
from sparklines.operators.segments import segment_spans

LINES = ["This is a test line", "Another line with Test", "No match here", "test test test"]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(LINES)], "src string, line_idx long, raw string")


def found(df):
    return {r.line_idx: [(m.s, m.e) for m in r.matches] for r in df.collect()}


def test_search(lines):
    assert found(search.search(lines, "test")) == {0: [(10, 14)], 3: [(0, 4), (5, 9), (10, 14)]}
    assert found(search.search(lines, "test", case=False)) == {0: [(10, 14)], 1: [(18, 22)], 3: [(0, 4), (5, 9), (10, 14)]}
    assert found(search.search(lines, "t.st$")) == {3: [(10, 14)]}
    assert search.total_matches(search.search(lines, "test")).first()[:] == (2, 4)


def test_spans_in_bytes_and_characters(spark):
    df = spark.createDataFrame([("é1ü22",)], "t string")
    assert [tuple(m) for m in df.select(find_spans(F.col("t"), "[0-9]+").alias("m")).first().m] == [(2, 3), (5, 7)]
    assert [tuple(m) for m in df.select(find_spans(F.col("t"), "[0-9]+", "chars").alias("m")).first().m] == [(1, 2), (3, 5)]
    assert [tuple(m) for m in df.select(find_spans(F.col("t"), "[0-9]*", "chars").alias("m")).first().m] == [(0, 0), (1, 2), (2, 2), (3, 5), (5, 5)]
    df = spark.createDataFrame([("",), (None,)], "t string")
    assert [r.m and [tuple(m) for m in r.m] for r in df.select(find_spans(F.col("t"), "x*").alias("m")).collect()] == [[(0, 0)], None]


@pytest.mark.parametrize("bucket", [1, 2, 100])
def test_occurrences_do_not_depend_on_the_bucket(lines, bucket):
    got = search.occurrences(search.search(lines, "t"), bucket).orderBy("occurrence").collect()
    assert [r.occurrence for r in got] == list(range(1, len(got) + 1))
    assert [(r.line_idx, r.s) for r in got] == sorted((r.line_idx, r.s) for r in got)


def test_next_and_previous_wrap(lines):
    hits = search.search(lines, "test")
    at = lambda *a, **k: tuple(search.next_match(hits, *a, **k).select("line_idx", "s").first())
    assert at(0) == (0, 10)
    assert at(0, 10) == (3, 0)
    assert at(3, 10) == (0, 10)
    assert at(0, 10, back=True) == (3, 10)
    assert at(3, 5, back=True) == (3, 0)


def test_levels_and_goto(spark):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(["info", "an ERRor", "x", "critical", "warn"])], "src string, line_idx long, raw string")
    got = search.next_level(df, search.line_level(F.col("raw")), bucket=2).orderBy("line_idx").collect()
    assert [(r.prev, r.next) for r in got] == [(None, 1), (None, 3), (1, 3), (1, None), (3, None)]
    some = df.filter("line_idx IN (0, 4)")
    assert search.goto_line(some, 3).first().line_idx == 0
    assert search.goto_line(some, 4).first().line_idx == 4
    with pytest.raises(ValueError):
        search.goto_line(some, 0)


def test_spans_of_filters(lines):
    got = search.match_spans(lines, filter_set(("Include", "test"), ("Exclude", "a"))).filter("line_idx = 0").collect()
    assert [(r.filter_id, r.s, r.e) for r in got] == [(0, 10, 14)]
    whole = search.match_spans(lines, filter_set(("Include", "test")), match_only=False).filter("line_idx = 0").first()
    assert (whole.s, whole.e) == (0, 19)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("GET /api/item/550e8400-e29b-41d4-a716-446655440000 200 from 10.0.0.1", [(0, 3, "http_get"), (14, 50, "uuid"), (51, 54, "status_2xx"), (60, 68, "ip_address")]),
        ("AppleWebKit/537.36 Chrome/120.0.0.0", []), ("addr 999.999.999.999 invalid", []), ("status 100 Continue", []),
        ("GET /api/v2/items/300/details HTTP/1.1", [(0, 3, "http_get")]), ("HEAD 404 503", [(0, 4, "http_other"), (5, 8, "status_4xx"), (9, 12, "status_5xx")]),
        ("at 2001:db8:0:0:0:0:2:1 now", [(3, 23, "ip_address")]),
    ],
)
def test_values(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(value_spans(F.col("t")).alias("v")).first().v
    assert [tuple(x) for x in got] == want


def test_values_switched_off(spark):
    got = spark.createDataFrame([("GET 200",)], "t string").select(value_spans(F.col("t"), ("http_get",)).alias("v")).first().v
    assert [x.tag for x in got] == ["status_2xx"]


def test_segments(spark):
    rows = [("f", 0, 0, 10, 500, "A", None), ("f", 0, 3, 6, 1000, "B", "b"), ("f", 0, 8, 12, 0, "C", None), ("f", 0, 10, 11, 5, "C", None)]
    df = spark.createDataFrame(rows, "src string, line_idx long, s int, e int, priority int, a string, b string")
    got = [(r.s, r.e, r.a, r.b) for r in segment_spans(df).orderBy("s").collect()]
    assert got == [(0, 3, "A", None), (3, 6, "B", "b"), (6, 10, "A", None), (10, 12, "C", None)]


def test_display(spark):
    line = '{"time":"T","level":"INFO","span":{"name":"s","k":"v"},"fields":{"message":"m","n":1}}'
    df = with_parts(spark.createDataFrame([("f", 0, line), ("f", 1, "raw")], "src string, line_idx long, raw string"), "json")
    show = lambda **k: [r.t for r in df.orderBy("line_idx").select(project.display_text(F.col("raw"), F.col("parts"), **k).alias("t")).collect()]
    assert show() == ["T INFO  s: v 1 m", "raw"]
    assert show(keys=True) == ["T INFO  s: k=v n=1 m", "raw"]
    assert show(hidden=("ts", "span.k", "n")) == ["INFO  s m", "raw"]
    assert show(layout=["fields.message", "span.k", "fields.n", "span.name", "x"]) == ["m v 1 s", "raw"]
    assert show(layout=["x"]) == [line, "raw"]


def test_field_names_and_index(spark):
    rows = ['{"b":1,"a":2,"msg":"x","level":"INFO","span":{"name":"n","k":"v"},"fields":{"z":3}}', '{"a":5,"time":"t","text":"y"}']
    df = with_parts(spark.createDataFrame([("f", i, x) for i, x in enumerate(rows)], "src string, line_idx long, raw string"), "json")
    names = [r.name for r in profile.field_names(df, "json").orderBy("position").collect()]
    assert names == ["time", "level", "a", "b", "fields.z", "span.k", "span.name", "msg", "text"]
    index = {r.name: (r.n, r.n_values, r.low, r.high) for r in profile.field_index(df, "json").collect()}
    assert index["a"] == (2, 2, "2", "5")
    assert index["msg"] == (1, 0, None, None)
    assert index["span.k"] == (1, 1, "v", "v")
    guess = {r.name: (r.n, r.n_values, r.low, r.high) for r in profile.field_index(df, "json", exact=False).collect()}
    assert guess == index
    values = {(r.name, r.value): r.n for r in profile.field_values(df, "json").collect()}
    assert values[("a", "2")] == values[("a", "5")] == values[("level", "INFO")] == 1
    assert not any(name in ("msg", "time", "text") for name, _ in values)
