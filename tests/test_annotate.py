from pyspark.sql import functions as F

from sparklines.operators import annotate


def tables(spark):
    lines = spark.createDataFrame([("f.log", i, x) for i, x in enumerate(["alpha", "beta", "gamma", "delta"])], "src string, line_idx long, raw string")
    marks = spark.createDataFrame([("f.log", 0), ("f.log", 2), ("f.log", 9)], "src string, line_idx long")
    comments = spark.createDataFrame([(1, "f.log", "My note", [0, 1])], "comment_id long, src string, text string, line_indices array<bigint>")
    return lines, marks, comments


def test_report(spark):
    found = annotate.entries(*tables(spark))
    got = [(r.commentary, r.lines, r.line_numbers) for r in found.orderBy("first", "kind").collect()]
    assert got == [("My note", "1: alpha\n2: beta", "1, 2"), ("", "3: gamma", "3")]
    text = annotate.report(found, "# {{filename}} {{date}}\n", "## {{commentary}} [{{line_numbers}}]\n{{lines}}\n", "end", F.lit("2024-01-01")).first().report
    assert text == "# f.log 2024-01-01\n## My note [1, 2]\n1: alpha\n2: beta\n##  [3]\n3: gamma\nend"


def test_marks(spark):
    lines, marks, comments = tables(spark)
    assert [r.raw for r in annotate.marked_lines(lines, marks).orderBy("line_idx").collect()] == ["alpha", "gamma"]
    assert {r.line_idx for r in annotate.standalone_marks(marks, comments).collect()} == {2, 9}
    spots = spark.createDataFrame([("f", i) for i in (1, 2, 3, 7, 9, 10, 10)], "src string, line_idx long")
    assert sorted((r.first, r.last, r.n) for r in annotate.runs(spots).collect()) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_runs_over_bucket_ends_and_reports_in_pieces(spark):
    import random

    from sparklines.operators.annotate import entries, in_runs, report, report_fragments, runs

    rng = random.Random(3)
    spots = {(s, i) for s in "ab" for i in range(300) if rng.random() < (0.8 if s == "a" else 0.3)} | {("long", i) for i in range(5, 90)}
    df = spark.createDataFrame([*spots, *list(spots)[:20]], "src string, line_idx long")
    want, first = {}, {}
    for s, i in sorted(spots):
        first[s, i] = first[s, i - 1] if (s, i - 1) in spots else i
        want.setdefault((s, first[s, i]), []).append(i)
    for bucket in (1, 3, 8, 1000):
        assert {(r.src, r.line_idx): r.run for r in in_runs(df, bucket).collect()} == first
        assert {(r.src, r.first): (r.last, r.n) for r in runs(df, bucket).collect()} == {k: (v[-1], len(v)) for k, v in want.items()}
    lines = spark.createDataFrame([(s, i, f"{s}{i}") for s in ("a", "b", "long") for i in range(250)], "src string, line_idx long, raw string")
    comments = spark.createDataFrame([(1, "a", "one", [3, 7]), (2, "a", "gone", [9999]), (3, "c", "of nothing", [1])], "comment_id long, src string, text string, line_indices array<long>")
    day, templates = F.lit("2024-02-01"), ("# {{filename}} {{date}}\n", "- {{commentary}} ({{line_numbers}}) {{filename}}\n{{lines}}\n", "end\n")
    whole = {r.src: r.report for r in report(entries(lines, df, comments), *templates, day).collect()}
    pieces = report_fragments(lines, df, comments, *templates, day).collect()
    key = lambda r: tuple((x is not None, x) for x in (r.section, r.first, r.kind, r.ref, r.part, r.line_idx))
    joined = {}
    for r in sorted(pieces, key=key):
        joined[r.src] = joined.get(r.src, "") + r.text
    assert joined == whole and max(len(r.text) for r in pieces) < 60
