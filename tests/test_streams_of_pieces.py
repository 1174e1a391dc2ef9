"""Streams cut anywhere, followed by ranges, restarted, torn."""

import random

import duckdb
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import sparklines.plans.catalog_jobs  # noqa: F401 (registers its queries)
from sparklines.plans.catalog import QUERIES, SQL
from sparklines.streaming import follow
from sparklines.streaming.follow import RangeReader, follow_ranges
from sparklines.streaming.jobs import latest_lines, write_numbered
from sparklines.streaming.pipes import whole_lines
from sparklines.streaming.runner import keep_running
from sparklines.streaming.versions import Versions

RECORDS = "src string, n long, value binary, last boolean"


def test_records_cut_anywhere_over_restarts(spark, tmp_path):
    rng, rows, want = random.Random(2), [], {}
    for src in ("a", "b", "c", "d"):
        lines = ["" if rng.random() < 0.2 else "é" * rng.randrange(1, 9) + str(i) for i in range(60)]
        text = "\r\n".join(lines).encode() + (b"" if src in "ab" else b"\n")
        n = 0
        while text:
            k = rng.randrange(1, 12)
            rows.append((src, n, text[:k], src != "b" and len(text) <= k))
            text, n = text[k:], n + 1
        want[src] = lines[:-1] if src == "b" else lines
    rows += [("a", 10**6, None, None), ("only", 0, b"part", None)]
    parts = [rows[0::3], rows[1::3], rows[2::3]]
    where = lambda r: min(2, r[1] * 3 // 70)  # noqa: E731  pieces arrive in order, but shuffled within a batch
    parts = [[r for r in rows if where(r) == k] for k in range(3)]
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, RECORDS).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = whole_lines(spark.readStream.schema(RECORDS).parquet(str(tmp_path / "in")), "n", src="src", end="last")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("src", "line_idx").collect():
        got.setdefault(r.src, []).append((r.line_idx, r.raw))
    assert got == {s: list(enumerate(lines)) for s, lines in want.items()}


def read_all(reader, start, end):
    return sorted((r["at"], r["raw"].decode(), r["blk"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist())


@pytest.mark.parametrize("piece", [1, 5, 64, 1 << 20])
def test_ranges_give_every_line_once(tmp_path, monkeypatch, piece):
    rng = random.Random(piece)
    data = b"".join(b"x" * rng.choice([0, 1, 3, 30]) + rng.choice([b"\n", b"\n", b"\r\n"]) for _ in range(200)) + b"open"
    log = tmp_path / "x.log"
    reader, start, got = RangeReader(str(log), "beginning", piece, 0), {}, []
    ends = sorted(rng.sample(range(len(data)), 8)) + [len(data)]
    log.write_bytes(b"")
    for a, b in zip([0, *ends], ends, strict=False):
        with log.open("ab") as f:
            f.write(data[a:b])
        monkeypatch.setattr(follow, "open", lambda *a: pytest.fail("the driver opened a file"), raising=False)
        end = reader.latestOffset()
        monkeypatch.undo()
        got += read_all(reader, start, end)
        start = end
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line.replace(b"\r", b"").decode()))
        at += len(line) + 1
    assert [g[:2] for g in sorted(got)] == want


def test_offsets_limits_rotation_and_ends(tmp_path):
    for name in "ab":
        (tmp_path / name).write_bytes(b"one\ntwo\nthr")
    limited = RangeReader(str(tmp_path), "beginning", 4, 14)
    one = limited.latestOffset()
    assert [v[0] for v in one.values()] == [11, 3] and len(limited.partitions({}, one)) == 4
    two = limited.latestOffset()
    assert [v[0] for v in two.values()] == [11, 11]
    assert [x[1] for x in read_all(limited, one, two)] == ["one", "two"]
    late = RangeReader(str(tmp_path / "a"), "end", 100, 0)
    begin = late.initialOffset()
    (tmp_path / "a").write_bytes(b"one\ntwo\nthree\n")
    more = late.latestOffset()
    assert read_all(late, begin, more) == [(8, "three", 11)]
    (tmp_path / "a").write_bytes(b"new\n")
    shrunk = late.latestOffset()
    assert shrunk == {str(tmp_path / "a"): [4, 4, 1]} and read_all(late, more, shrunk) == []
    with (tmp_path / "a").open("ab") as f:
        f.write(b"next\n")
    last = late.latestOffset()
    assert read_all(late, shrunk, last) == [(4, "next", 4)]


def test_a_large_file_is_many_partitions(tmp_path):
    with (tmp_path / "big").open("wb") as f:
        f.truncate(1 << 30)
    reader = RangeReader(str(tmp_path / "big"), "beginning", 32 << 20, 0)
    assert len(reader.partitions({}, reader.latestOffset())) == 32


def test_numbers_over_batches_restarts_and_repeats(spark, tmp_path):
    logs, out, mark = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "mark")
    logs.mkdir()
    texts = {"a": [f"a {i}" for i in range(500)], "b": [f"b {i}" for i in range(70)]}
    for a, b in ((0, 100), (100, 101), (101, 500)):
        for name, lines in texts.items():
            with (logs / name).open("a") as f:
                f.write("".join(x + "\n" for x in lines[a:b]))
        write_numbered(follow_ranges(spark, str(logs), piece=97), out, mark, once=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.raw, r.line_idx) for r in rows) == sorted((x, i) for lines in texts.values() for i, x in enumerate(lines))


def test_versions_stand_repeats_and_torn_writes(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    add = lambda n: lambda known: spark.range(n, n + 1).unionByName(known) if known is not None else spark.range(n, n + 1)
    assert versions.latest() is None
    versions.make(0, add(0))
    versions.make(1, add(1))
    ids = lambda df: sorted(r.id for r in df.collect())
    versions.make(1, add(1))  # the batch again, after a crash that kept its number
    assert ids(versions.latest()) == [0, 1]
    versions.make(2, add(2))
    (tmp_path / "v" / "v2" / "_SUCCESS").unlink()  # torn: files without their end mark
    assert ids(versions.latest()) == [0, 1]
    assert ids(versions.make(2, add(2))) == [0, 1, 2]
    with pytest.raises(Exception, match="broken"):
        versions.make(3, lambda known: known.select(F.raise_error(F.lit("broken")).alias("id")))
    assert ids(versions.latest()) == [0, 1, 2]
    assert versions.complete()[-1] == 2 and len(versions.complete()) <= 2


def test_latest_lines_after_a_crash_within_a_batch(spark, tmp_path, monkeypatch):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "x").write_text("".join(f"{i}\n" for i in range(5)))
    run = lambda: latest_lines(follow.follow_files(spark, str(logs)), "newest", str(tmp_path / "m"), n=3, once=True).awaitTermination()
    run()
    with (logs / "x").open("a") as f:
        f.write("5\n6\n")
    whole = Versions.show_as
    monkeypatch.setattr(Versions, "show_as", lambda *a: 1 / 0)  # the version is written, the batch not committed
    with pytest.raises(StreamingQueryException):
        run()
    monkeypatch.setattr(Versions, "show_as", whole)
    run()
    assert sorted(r.raw for r in spark.table("newest").collect()) == ["4", "5", "6"]


def test_restarts_with_waits(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    calls, waits, mark = [], [], ["m"]

    def start():
        calls.append(len(calls))
        if len(calls) == 1:
            raise ConnectionError("refused")
        fails = len(calls) in (2, 3, 4, 5)

        def work(batch, _):
            if fails:
                raise RuntimeError(f"attempt {len(calls)}")
            batch.write.mode("overwrite").parquet(str(tmp_path / "out"))

        return spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / mark[0])).trigger(availableNow=True).start()

    assert keep_running(spark, start, sleep=waits.append) == 5
    assert waits == [0, 2, 5, 10, 10] and spark.read.parquet(str(tmp_path / "out")).count() == 5
    calls[:], mark[0] = [0], "other"
    with pytest.raises(StreamingQueryException, match="attempt 2"):
        keep_running(spark, start, fatal=lambda e: "attempt" in str(e), sleep=waits.append)
    assert len(waits) == 5
    calls.clear()
    with pytest.raises(ConnectionError):
        keep_running(spark, lambda: calls.clear() or start(), attempts=2, sleep=waits.append)
    assert waits[5:] == [0, 2]


def test_many_small_files_share_partitions(tmp_path):
    for i in range(300):
        (tmp_path / f"f{i:03}").write_bytes(b"one\ntwo\n" * (i % 4))
    reader = RangeReader(str(tmp_path), "beginning", 5, 0)
    end = reader.latestOffset()
    assert len(reader.partitions({}, end)) <= 2 * follow.LEAST
    got = [(r["src"], r["at"], r["raw"]) for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == [(str(tmp_path / f"f{i:03}"), 4 * n, (b"one", b"two")[n % 2]) for i in range(300) for n in range(2 * (i % 4))]


def test_rotation_of_a_file_that_shrinks_to_nothing(spark, tmp_path):
    """A kind of event without a line among the first 50 of its 500: its file shrinks to nothing before it grows again."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 500 AND NOT (event_type = 'view' AND event_id < 50)")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT name, rotation, raw FROM ({SQL['follow_rotation']})").fetchall()
    assert sorted(tuple(r) for r in QUERIES["follow_rotation"](spark, str(tmp_path)).collect()) == sorted(want)
    assert any(name == "view-0" and turn for name, turn, _ in want)
