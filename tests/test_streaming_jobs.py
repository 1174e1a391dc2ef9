import struct

from pyspark.sql import functions as F

from sparklines.model import FIELD, filter_set
from sparklines.operators.detect import with_parts
from sparklines.sources.dlt import decode_messages, frame_messages
from sparklines.streaming.follow import follow_files
from sparklines.streaming.jobs import detect_as_it_comes, error_rates, latest_lines, pipe_lines, running_counts, stream_visible


def test_latest_lines_and_formats(spark, tmp_path):
    log = tmp_path / "x.log"
    log.write_text("INFO:a:one\nINFO:a:two\nINFO:a:three\n")
    for _ in range(2):
        latest_lines(follow_files(spark, str(log)), "latest", str(tmp_path / "m1"), n=2, once=True).awaitTermination()
        detect_as_it_comes(follow_files(spark, str(log)), "found_formats", str(tmp_path / "m2"), once=True).awaitTermination()
        with log.open("a") as f:
            f.write("ERROR:a:four\n")
    assert [r.raw for r in spark.table("latest").orderBy("line_idx").collect()] == ["INFO:a:three", "ERROR:a:four"]
    assert [r.format for r in spark.table("found_formats").collect()] == ["common"]


def test_binary_stream(spark, tmp_path):
    body = bytes([0x41, 0]) + b"APP1CTX1"
    message = bytes([0x21, 7]) + struct.pack(">H", 4 + len(body)) + body
    spark.createDataFrame([("can", bytearray(message * 2))], "src string, content binary").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src string, content binary").parquet(str(tmp_path / "in"))
    lines = decode_messages(frame_messages(stream), F.lit("2024/01/01 00:00:00.000000"))
    q = lines.writeStream.format("memory").queryName("dlt_lines").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("dlt_lines").collect()
    assert len(got) == 2 and got[0].raw.startswith("2024/01/01 00:00:00.000000 0 007 ---- APP1 CTX1 log info verbose 0")


def test_field_filters_and_rates_on_a_stream(spark, tmp_path):
    text = "2024-01-01T00:00:10Z ERROR app: a\n2024-01-01T00:00:20Z INFO app: b\n2024-01-01T00:05:00Z ERROR web: c"
    spark.createDataFrame([(text,)], "value string").write.parquet(str(tmp_path / "in"))
    lines = pipe_lines(spark.readStream.schema("value string").parquet(str(tmp_path / "in")))
    shown = stream_visible(lines, filter_set(("Include", FIELD + "level:ERROR"), ("Exclude", FIELD + "target:web")), "common")
    q = shown.select("raw").writeStream.format("memory").queryName("shown").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.raw[-1] for r in spark.table("shown").collect()] == ["a"]
    parsed = with_parts(lines, "common").select(F.try_to_timestamp("parts.timestamp").alias("t"), F.col("parts.level").alias("level"), "parts", "raw")
    q = error_rates(parsed, "t", "level").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.window.start.minute, r.level, r.n) for r in spark.table("rates").collect()) == [(0, "ERROR", 1), (0, "INFO", 1), (5, "ERROR", 1)]
    q = running_counts(parsed, filter_set(("Include", FIELD + "target:web"))).writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("hits").collect()] == [1]
