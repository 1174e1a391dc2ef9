"""Parts of files read by byte ranges, against the whole text; plans that move no lines."""

import io
import random

import pytest
from pyspark.sql import functions as F

from sparklines.model import filter_set
from sparklines.operators.visibility import visible_lines
from sparklines.plans.headless import FilterJob
from sparklines.sources import lines as L
from sparklines.sources.lines import head_bytes, read_lines, tail_bytes
import sparklines.plans.catalog_jobs  # noqa: F401 (registers its queries)
from sparklines.plans.catalog import QUERIES
from sparklines.sources.ranges import _lines_from, head_of_files, last_shown, list_files, range_lines, split_ranges, tail_of_files


@pytest.fixture
def logs(tmp_path):
    rng = random.Random(5)
    texts = {}
    for name, end in (("a b.log", b"\n"), ("b.log", b""), ("c.log", b"\n")):
        lines = [b"x" * rng.choice([0, 1, 5, 40, 400]) + (b" ERROR" if rng.random() < 0.1 else b"") + (b"\r" if i % 3 else b"") for i in range(400)]
        texts[name] = b"\n".join(lines) + end
    texts["long.log"] = b"y" * 9000 + b"\nz\n" + b"w" * 5000
    texts["empty.log"], texts["feeds.log"] = b"", b"\n" * 50
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, texts


def split(data):
    lines = data.split(b"\n")
    return lines[:-1] if data.endswith(b"\n") or not data else lines


def by_name(df):
    out = {}
    for r in df.withColumn("src", F.substring_index(F.replace("src", F.lit("%20"), F.lit(" ")), "/", -1)).collect():
        out.setdefault(r.src, []).append(r)
    return out


@pytest.mark.parametrize("step", [1, 7, 100, 4096, 1 << 20])
def test_every_line_is_in_one_range(spark, logs, step):
    folder, texts = logs
    some = "feeds.log" if step == 1 else "*.log"
    got = by_name(range_lines(split_ranges(list_files(spark, str(folder / some)), step=step)))
    for name, data in texts.items():
        rows = sorted(got.get(name, []), key=lambda r: r["at"])
        if step > 1 or name == some:
            assert [bytes(r.raw) for r in rows] == split(data)
            assert [data[r["at"] : r["at"] + len(r.raw)] for r in rows] == split(data)
            assert [(r.blk, r.mid) for r in rows] == sorted((r.blk, r.mid) for r in rows) and all(r["at"] // step * step == r.blk for r in rows)


@pytest.mark.parametrize("size", [0, 1, 6, 50, 8999, 9001, 9003, 1 << 20])
def test_heads_and_tails_of_files(spark, logs, size):
    folder, texts = logs
    head, tail = by_name(head_of_files(spark, str(folder), size, step=64)), by_name(tail_of_files(spark, str(folder), size, step=64))
    plain = lambda lines: [x.replace(b"\r", b"").decode() for x in lines]
    for name, data in texts.items():
        cut = data[:size]
        assert [r.raw for r in sorted(head.get(name, []), key=lambda r: r["at"])] == plain(split(cut[: cut.rfind(b"\n") + 1]))
        begin = max(0, len(data) - size)
        feed = data.find(b"\n", begin)
        want = data if begin == 0 else data[feed + 1 :] if feed >= 0 else b""
        assert [r.raw for r in sorted(tail.get(name, []), key=lambda r: r["at"])] == plain(split(want) if size else [])


def test_last_shown_reads_the_end_only(spark, logs):
    folder, _ = logs
    filters = filter_set(("Exclude", "xxxx ERROR"), ("Include", "ERROR"))
    shown = lambda lines: visible_lines(lines, filters)
    whole = by_name(visible_lines(read_lines(spark, str(folder)), filters).orderBy("line_idx"))
    for n in (1, 4, 1000):
        got = by_name(last_shown(spark, str(folder), shown, n, step=256).orderBy("at"))
        assert {k: [r.raw for r in v] for k, v in got.items()} == {k: [r.raw for r in v][-n:] for k, v in whole.items()}
    asked = split_ranges(list_files(spark, str(folder / "long.log")), F.greatest(F.col("size") - 100, F.lit(0)), None, 64).collect()
    assert min(r.start for r in asked) == 9000 + 3 + 5000 - 100  # no range begins before the last bytes


def test_job_on_the_last_lines(spark, logs):
    folder, _ = logs
    job = FilterJob(str(folder / "c.log"), include=["ERROR"], exclude=["xxxx ERROR"])
    every = [r.raw for r in job.run(spark).orderBy("line_idx").collect()]
    assert [r.raw for r in job.run_tail(spark, 3, step=500).orderBy("at").collect()] == every[-3:]


def test_numbering_moves_no_lines(spark, tmp_path, monkeypatch):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(3000)))
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        lines = read_lines(spark, str(tmp_path), by_name=True)
        plan = lines._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        stream = plan[: plan.index("BroadcastExchange")]  # the lines' side comes first
        assert " Exchange" not in stream and "Sort" not in stream
        assert all(r.raw.split()[:2] == [r.src[0], str(r.line_idx)] for r in lines.collect())
        monkeypatch.setattr(L, "BROADCAST_SPLITS", 3)
        more = read_lines(spark, str(tmp_path), by_name=True)
        assert "SortMergeJoin" in more._jdf.queryExecution().toString()
        assert sorted(map(tuple, more.collect())) == sorted(map(tuple, lines.collect()))
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)


def test_budgets_over_buckets_of_lines(spark):
    rows = [(s, i, "x" * (i % 7)) for s in ("f", "g") for i in range(9000 if s == "f" else 3)]
    df = spark.createDataFrame(rows, "src string, line_idx long, raw string")
    for size in (0, 1, 100, 20_000, 10**6):
        for last, got in ((False, head_bytes(df, size)), (True, tail_bytes(df, size))):
            want = set()
            for s in ("f", "g"):
                used = 0
                for _, i, raw in sorted((r for r in rows if r[0] == s), key=lambda r: -r[1] if last else r[1]):
                    used += len(raw) + 1
                    if used > size:
                        break
                    want.add((s, i))
            assert {(r.src, r.line_idx) for r in got.collect()} == want


def test_little_is_read_beyond_a_range():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n):
            data = super().read(n)
            self.taken += len(data)
            return data

    data = b"x" * 30 + b"\n"
    f = Counted(data * 400_000)
    got = [x for _, lines, _ in _lines_from(f, 4096, 8192, 400_000 * 31) for x in lines]
    assert got == [b"x" * 30] * 132 and f.taken < 10_000
    long = Counted(b"y" * 5_000_000 + b"\n" + b"z" * 9_000_000)
    assert [x for _, lines, _ in _lines_from(long, 0, 10, 14_000_001) for x in lines] == [b"y" * 5_000_000] and long.taken < 10_000_000


def test_head_needs_no_join(spark):
    plan = QUERIES["head_of_file"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
