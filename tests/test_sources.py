import struct

import pytest
from pyspark.sql import functions as F

from sparklines.model import filter_set
from sparklines.operators.visibility import visible_lines
from sparklines.plans.headless import FilterJob
from sparklines.sources import dlt
from sparklines.sources.lines import fingerprints, head_bytes, read_lines, tail_bytes, tail_lines, write_lines
from sparklines.streaming.follow import FollowReader, follow_files
from sparklines.streaming.jobs import pipe_lines, running_counts, stream_visible, write_visible


def raws(df):
    return [r.raw for r in df.orderBy("src", "line_idx").collect()]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"a\r\nb\rc\nd", ["a", "bc", "d"]), (b"a\n\n", ["a", ""]), (b"", []),
        (b"\x1b[31mred\x1b[0m \x1b]0;title\x07x\x1b]8;;u\x1b\\y\x1bMz\n", ["red xyz"]),
    ],
)
def test_reading(spark, tmp_path, data, want):
    (tmp_path / "a.log").write_bytes(data)
    assert raws(read_lines(spark, str(tmp_path / "a.log"), clean=True)) == want


def test_numbers_hold_over_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.log").write_text("".join(f"{name} {i} {'x' * (i % 50)}\n" for i in range(3000)))
    (tmp_path / ".hidden").write_text("no\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for limit in ("10k", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
            got = read_lines(spark, str(tmp_path), by_name=True).collect()
            assert len(got) == 6000
            assert all(r.raw.split()[:2] == [r.src[0], str(r.line_idx)] for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_heads_and_tails(spark):
    df = spark.createDataFrame([("f", i, "x" * 9) for i in range(10)], "src string, line_idx long, raw string")
    assert [r.line_idx for r in head_bytes(df, 35).orderBy("line_idx").collect()] == [0, 1, 2]
    assert [r.line_idx for r in tail_bytes(df, 35).orderBy("line_idx").collect()] == [7, 8, 9]
    assert [r.line_idx for r in tail_lines(df, 2).orderBy("line_idx").collect()] == [8, 9]


def test_job_writes_what_shows_in_order(spark, tmp_path):
    (tmp_path / "in.log").write_text("".join(f'{{"level":"{"ERROR" if i % 10 == 0 else "INFO"}","msg":"m{i}"}}\n' for i in range(500)))
    job = FilterJob(str(tmp_path / "in.log"), exclude=["m100"], fields=["level=ERROR"])
    want = [f'{{"level":"ERROR","msg":"m{i}"}}' for i in range(0, 500, 10) if i != 100]
    assert raws(job.run(spark, str(tmp_path / "out"))) == want
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == want
    assert raws(FilterJob(str(tmp_path / "in.log"), include=["m4[0-9]{2}", "m3"], exclude=["m39"]).run(spark))[:1] == ['{"level":"INFO","msg":"m3"}']


def test_fingerprint_changes_with_the_file(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    one = fingerprints(spark, str(tmp_path / "a")).first().fingerprint
    (tmp_path / "a").write_text("12")
    assert fingerprints(spark, str(tmp_path / "a")).first().fingerprint != one


def test_stream_equals_batch_over_growth_and_restart(spark, tmp_path):
    log, out, mark = tmp_path / "x.log", str(tmp_path / "out"), str(tmp_path / "mark")
    filters = filter_set(("Exclude", "7"), ("Include", "l[0-9]+"))

    def pump():
        write_visible(stream_visible(follow_files(spark, str(log)), filters), out, mark, once=True).awaitTermination()

    log.write_bytes(b"".join(b"l%d\n" % i for i in range(20)) + b"l20 par")
    pump()
    with log.open("ab") as f:
        f.write(b"tial\r\nl21\nl27\n")
    pump()
    pump()
    got = spark.read.parquet(out).orderBy("line_idx").select("line_idx", "raw").collect()
    want = visible_lines(read_lines(spark, str(log)), filters).orderBy("line_idx").select("line_idx", "raw").collect()
    assert got == want


def test_offsets_of_a_file_that_shrinks(tmp_path):
    log = tmp_path / "x.log"
    log.write_bytes(b"a\nb\npart")
    reader = FollowReader(str(log), "beginning")
    one = reader.latestOffset()
    assert one == {str(log): [4, 2, 0]}
    assert [r[1:3] for p in reader.partitions({}, one) for r in reader.read(p)] == [(0, "a"), (1, "b")]
    log.write_bytes(b"c\n")
    two = reader.latestOffset()
    assert two == {str(log): [2, 2, 1]}
    with log.open("ab") as f:
        f.write(b"d\n")
    three = reader.latestOffset()
    assert [r[2] for p in reader.partitions(two, three) for r in reader.read(p)] == ["d"]
    assert FollowReader(str(log), "end").initialOffset() == {str(log): [4, 2, 0]}


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("a error\nb",), ("c error\r\nd error\n",)], "value string").write.parquet(str(tmp_path / "in"))
    stream = pipe_lines(spark.readStream.schema("value string").parquet(str(tmp_path / "in")))
    counted = running_counts(stream, filter_set(("Include", "error"), ("Exclude", "b"), ("Include", "zzz")))
    q = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.pattern: r.n for r in spark.table("counts").collect()} == {"error": 3, "b": 1}


def message(payload=b"", args=0, flags=0x21, info=0x41, names=b"APP1CTX1", extra=b""):
    ext = bytes([info, args]) + names if flags & 1 else b""
    body = extra + ext + payload
    return bytes([flags, 7]) + struct.pack(">H", 4 + len(body)) + body


def storage(msg, seconds=1705314645, micros=123456):
    return b"DLT\x01" + struct.pack("<II", seconds, micros) + b"ECU1" + msg


def decoded(spark, data):
    df = spark.createDataFrame([("f", bytearray(data))], "src string, content binary")
    return raws(dlt.decode_messages(dlt.frame_messages(df)))


def test_dlt_storage_and_arguments(spark):
    u32, s64, flag, text, f32, f64, raw = 0x43, 0x24, 0x11, 0x200, 0x83, 0x84, 0x400
    le = lambda t, b: struct.pack("<I", t) + b
    word = lambda t, b: le(t, struct.pack("<H", len(b)) + b)
    args = le(u32, struct.pack("<I", 4_000_000_000)) + le(s64, struct.pack("<q", -5)) + le(flag, b"\x01") + word(text, b"hi \xc3\xa9\0") + le(f32, struct.pack("<f", 1.5)) + le(f64, struct.pack("<d", -0.25)) + word(raw, b"\xff\x00") + le(0x03, b"\x01\x02\x03\x04")
    data = storage(message(args, 8)) + b"junk" + storage(message(b"plain\0\0", info=0x40)) + storage(message(b"\xff\xfe", flags=0x34, extra=b"ECU9" + struct.pack(">I", 77)))
    head = "2024/01/15 10:30:45.123456"
    assert decoded(spark, data) == [
        f"{head} 0 007 ECU1 APP1 CTX1 log info verbose 8 4000000000 -5 true hi é 1.5 -0.25 ff00 01020304",
        f"{head} 0 007 ECU1 APP1 CTX1 log info non-verbose 0 plain",
        f"{head} 77 007 ECU9 ---- ---- ---- ---- ---- 0 fffe",
    ]


def test_dlt_other_layouts_and_bad_lengths(spark):
    assert decoded(spark, message(info=0x24, flags=0x31, extra=struct.pack(">I", 36_000_000)) * 2) == ["0000/00/00 01:00:00.000000 36000000 007 ---- APP1 CTX1 network can non-verbose 0 "] * 2
    simple = b"DLT\x01ECU1APP\0CTX1" + struct.pack(">I", 1705314645) + struct.pack(">H", 2) + b"ok"
    assert decoded(spark, simple) == ["2024/01/15 10:30:45.000000 0 000 ECU1 APP CTX1 log info non-verbose 0 ok"]
    broken = storage(message())[:-12] + b"\xff\xff"
    assert len(decoded(spark, broken + storage(message()))) == 1
    assert decoded(spark, b"no log") == [] == decoded(spark, b"")
