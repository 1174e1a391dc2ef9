import itertools

import pytest
from pyspark.sql import functions as F

from sparklines.functions.timestamps import canonical, time_of_day
from sparklines.model import DATE, FIELD, FilterDef, filter_set, load_filters, save_filters
from sparklines.operators.detect import with_parts
from sparklines.operators.visibility import date_match, filter_counts, parse_date_filter, parse_field_filter, text_vote, visible, visible_lines

BASE = """Jun 28 10:00:01 myhost myapp[1234]: INFO: Application started
Jun 28 10:00:02 myhost myapp[1234]: ERROR: Connection failed
Jun 28 10:00:03 myhost kernel: Linux version 6.8.0-31-generic
Jun 28 10:00:04 myhost myapp[1234]: WARNING: Retrying connection
Jun 28 10:00:05 myhost myapp[1234]: INFO: Connection established
Jun 28 10:00:06 myhost sshd[5678]: DEBUG: Key exchange completed
plain text log line with no format""".split("\n")


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(BASE)], "src string, line_idx long, raw string").cache()


def shown(lines, *filters, **options):
    return [r.line_idx for r in visible_lines(lines, filter_set(*filters), **options).orderBy("line_idx").collect()]


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ([], [0, 1, 2, 3, 4, 5, 6]), ([("Include", "Connection")], [1, 4]), ([("Include", "ERROR"), ("Include", "WARNING")], [1, 3]),
        ([("Include", "INFO|ERROR")], [0, 1, 4]), ([("Exclude", "established"), ("Include", "Connection")], [1]),
        ([("Include", "Connection"), ("Exclude", "established")], [1, 4]), ([("Include", "CRITICAL")], []), ([("Exclude", "INFO")], [1, 2, 3, 5, 6]),
        ([("Include", "Connection"), ("Include", FIELD + "target:sshd")], [1, 4, 5]), ([("Include", FIELD + "target:sshd")], [5, 6]),
        ([("Exclude", FIELD + "pid:1234")], [2, 5, 6]), ([("Include", DATE + "10:00:03 .. 10:00:05")], [2, 3, 4, 6]),
    ],
)
def test_filters_on_the_base_file(lines, filters, want):
    assert shown(with_parts(lines, "syslog"), *filters) == want


def test_switch_and_disabled_filters_show_all(lines):
    assert shown(lines, ("Include", "x"), on=False) == list(range(7))
    off = [FilterDef(0, "nothing", "Include", enabled=False)]
    assert visible_lines(lines, off).count() == 7


def test_a_list_for_each_source(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("c", 0, "x")], "src string, line_idx long, raw string")
    got = visible_lines(df, {"a": filter_set(("Include", "y")), "b": filter_set(("Exclude", "x"))}).orderBy("src", "line_idx").collect()
    assert [(r.src, r.line_idx) for r in got] == [("a", 1), ("c", 0)]


def test_many_filters_use_an_array_and_agree(lines):
    many = filter_set(*[("Include", f"none{i}") for i in range(100)], ("Exclude", "established"), ("Include", "Connection"))
    assert [r.line_idx for r in visible_lines(lines, many).orderBy("line_idx").collect()] == [1]


def test_bad_regex_raises(lines):
    with pytest.raises(Exception, match="Unclosed"):
        shown(lines, ("Include", "a(b"))


def test_truth_table_against_a_plain_model(spark):
    """Every combination of text vote, date, field exclude and field include, with and without text includes."""
    rows, want = [], []
    for vote, date, exc, inc, has_inc, has_field in itertools.product("IEN", ("none", "hit", "miss", "no-ts"), (0, 1), ("match", "miss", "unparsed"), (0, 1), (0, 1)):
        if inc == "unparsed" and (exc or date in ("hit", "miss")) or vote == "I" and not has_inc:
            continue
        ts = {"hit": "2024-01-01T00:00:00Z", "miss": "2025-01-01T00:00:00Z", "none": "2025-01-01T00:00:00Z"}.get(date)
        rows.append(({"I": "yes", "E": "no", "N": "-"}[vote], ts, "bad" if exc else "ok", "in" if inc == "match" else "out", inc != "unparsed", date, has_inc, has_field))
        if vote == "E" or date == "miss" or exc:
            out = False
        elif vote == "I":
            out = True
        elif has_field and inc != "unparsed":
            out = inc == "match"
        else:
            out = not has_inc
        want.append(out)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, ts string, e string, f string, ok boolean, date string, has_inc int, has_field int")
    pair = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))
    parts = F.when(F.col("ok"), F.struct(F.col("ts").alias("timestamp"), F.lit(None).cast("string").alias("level"), F.array(pair("e", "e"), pair("f", "f")).alias("extra")))
    got = {}
    for dated, has_inc, has_field in itertools.product((0, 1), repeat=3):
        filters = filter_set(("Exclude", "no"), *([("Include", "yes")] if has_inc else []), *([("Include", DATE + "2024-01-01")] if dated else []), ("Exclude", FIELD + "e:bad"), *([("Include", FIELD + "f:in")] if has_field else []))
        part = df.filter((F.col("date") != "none") if dated else (F.col("date") == "none")).filter(f"has_inc = {has_inc} AND has_field = {has_field}")
        got |= {r.i: r.v for r in part.select("i", visible(F.col("raw"), parts, filters).alias("v")).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert len(rows) > 100


@pytest.mark.parametrize(
    ("expr", "ts", "want"),
    [
        ("09:00", "2024-01-01T09:00:59Z", True), ("09:00", "2024-01-01T09:01:00Z", False), ("Feb/21", "2023-02-21 10:00:00", True), ("02/21", "Feb 21 10:00:00", True),
        ("02-21", "2024-02-22T00:00:00Z", False), ("Feb 21", "Feb 21 23:59:59.9", True), ("09:00 .. 17:00", "2024-01-01T17:00:59Z", True),
        ("09:00..17:00", "2024-01-01T17:01:00Z", False), ("<= Feb 22", "2024-02-22T00:00:01Z", False), ("> 2024-02-21", "2024-02-21T00:00:01Z", True),
        ("2024-02-21 10:15", "2024/02/21 10:15:30", True), ("02/21/2024", "21/Feb/2024:10:00:00 +0000", True), ("2024-01-15", "[Mon Jan 15 10:30:00.123456 2024]", True),
        ("2024-01-15", "[    0.000000]", True), ("2024-01-15", "1700046000000000000", True), (">= 10:00:01", "Mon 2024-02-22 10:00:00 UTC", False), ("2024-02-21", "Feb 21 10:00:00", False),
    ],
)
def test_date_filters(spark, expr, ts, want):
    got = spark.createDataFrame([(ts,)], "t string").select(date_match(canonical(F.col("t")), parse_date_filter(expr)).alias("m")).first().m
    assert got is want


@pytest.mark.parametrize("expr", ["", "23:00 .. 01:00", "09:00 .. 2024-02-21", "13/40", "2024-13-01", "Feb 32", "25:00", "x", "> ", "2024-01-02 .. 2024-01-01", "2024-01-01 9:00"])
def test_bad_date_filters(expr):
    with pytest.raises(ValueError):
        parse_date_filter(expr)


def test_canonical_forms(spark):
    cases = {
        "2024-07-24T10:00:00Z": "2024-07-24 10:00:00.000000", "2024-07-24 10:00:00,12": "2024-07-24 10:00:00.120000", "Oct 11 22:14:15.1234567": "0000-10-11 22:14:15.123456",
        "Feb  2 10:15:30": "0000-02-02 10:15:30.000000", "10/Oct/2000:13:55:36 -0700": "2000-10-10 13:55:36.000000", "2024-02-30 00:00:00": "2024-02-30 00:00:00.000000", "": None, "x": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", canonical(F.col("t")).alias("c"), time_of_day(canonical(F.col("t"))).alias("s")).collect()
    assert {r.t: r.c for r in rows} == cases
    assert {r.t: r.s for r in rows}["10/Oct/2000:13:55:36 -0700"] == 13 * 3600 + 55 * 60 + 36


def test_field_expressions():
    assert parse_field_filter("a:b:c") == ("a", "b:c")
    assert parse_field_filter("a=b", "=") == ("a", "b")
    for bad in ("a", ":b", "a:"):
        with pytest.raises(ValueError):
            parse_field_filter(bad)


def test_counts_ignore_order_and_count_a_line_once(lines):
    filters = [FilterDef(i, p, t) for i, (t, p) in enumerate([("Exclude", "o"), ("Include", "Connection"), ("Include", "on"), ("Include", FIELD + "target:myapp")])]
    got = {r.id: r.n for r in filter_counts(with_parts(lines, "syslog"), filters).collect()}
    assert got == {0: 7, 1: 2, 2: 5, 3: 4}


def test_filter_file_round_trip(tmp_path):
    filters = filter_set(("Include", "ERROR"), ("Exclude", "DEBUG"), ("Include", "ERROR"))
    assert len(filters) == 2
    save_filters(filters, str(tmp_path / "f.json"))
    assert load_filters(str(tmp_path / "f.json")) == filters


def test_visibility_stays_in_the_jvm(lines):
    df = visible_lines(with_parts(lines, "syslog"), filter_set(("Include", "a.b"), ("Include", DATE + "10:00"), ("Exclude", FIELD + "pid:1")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_vote_is_the_first_match(lines):
    got = [r.v for r in lines.orderBy("line_idx").select(text_vote(F.col("raw"), filter_set(("Exclude", "INFO"), ("Include", "Connection"))).alias("v")).collect()]
    assert got == ["E", "I", None, None, "E", None, None]
