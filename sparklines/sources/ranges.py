"""Byte ranges of files as rows, and the lines that begin in them: what reads a part of a file touches no other bytes.

Files are listed by Spark; a task opens a file of a range itself, by Arrow's file systems (local and shared folders, HDFS, object stores).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklines.shared import cut, drop

#: Bytes of a range unless asked otherwise, most bytes read at once, and bytes first read for the end of a range's last line.
STEP, PIECE, OVER = 32 << 20, 4 << 20, 1 << 11
LINES = "src string, blk long, mid long, at long, next long, size long, raw binary"


def open_file(path: str) -> pa.NativeFile:
    """A file for random access."""
    local = re.sub("^file:(//)?", "", path)
    if local.startswith("/"):
        return fs.LocalFileSystem().open_input_file(local)
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def write_files(contents: DataFrame, path: str) -> None:
    """Write contents(name, content) as files of a folder; a task that runs again writes the same bytes."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                local = re.sub("^file:(//)?", "", f"{path}/{name}")
                system, at = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(f"{path}/{name}")
                system.create_dir(at.rsplit("/", 1)[0])
                with system.open_output_stream(at) as f:
                    f.write(content.as_py())
            yield batch.select(["name"])

    contents.select("name", "content").mapInArrow(written, "name string").write.format("noop").mode("overwrite").save()


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """files(src, path, size); no file is opened. src is the name that read_lines() gives."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("_metadata.file_path").alias("src"), "path", F.col("length").alias("size"))


def split_ranges(files: DataFrame, low: Column | int = 0, high: Column | None = None, step: int = STEP) -> DataFrame:
    """files with (start, end) of ranges of step bytes from low to high (else the file's end), dealt over all cores."""
    low, high = F.lit(low) if isinstance(low, int) else low, F.col("size") if high is None else high
    ranged = files.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter("_low < _high")
    ranged = ranged.withColumn("start", F.explode(F.sequence("_low", F.col("_high") - 1, F.lit(step).cast("long"))))
    ranged = ranged.withColumn("end", F.least(F.col("start") + step, "_high")).drop("_low", "_high")
    return ranged.repartition(max(files.sparkSession.sparkContext.defaultParallelism, 8))


def _lines_from(f: pa.NativeFile, start: int, end: int, size: int) -> Iterator[tuple[int, list[bytes], bool]]:
    """(place of the first, lines, whether the last one ends without a line feed) of the lines that begin in [start, end), some at a time."""
    at = max(0, start - 1)
    f.seek(at)
    held, first, beyond = b"", start == 0, OVER
    while True:
        if first and at >= end:
            return
        here = at + len(held)
        if here >= end:  # the last line goes on: little is read beyond the range, more only for a long line
            beyond = min(2 * beyond, PIECE)
        data = f.read(min(PIECE, max(end - here, beyond), max(1, size - here)))
        held += data
        if not first:  # the line that goes on from before the range belongs to the range before
            feed = held.find(b"\n")
            if feed < 0:
                at, held = at + len(held), b""
                if not data or at >= end:
                    return
                continue
            at, held, first = at + feed + 1, held[feed + 1 :], True
            if at >= end:
                return
        if not data:
            if held:
                yield at, [held], True
            return
        lines = held.split(b"\n")
        held = lines.pop()
        if lines:
            begins = at + np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])
            keep = int(np.searchsorted(begins[:-1], end))
            if keep:
                yield at, lines[:keep], False
            at = int(begins[-1])


def range_lines(ranges: DataFrame) -> DataFrame:
    """(src, blk, mid, at, next, size, raw) of the lines that begin in ranges(src, path, size, start, end).

    blk: the range's start; mid: the line's number in the range; at, next: places of its first byte and of what follows its line feed
    (beyond the size, if it has none). Only a line feed ends a line; raw is as it stands, without it. Memory follows the longest line.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                count = 0
                with open_file(r["path"]) as f:
                    for at, lines, _ in _lines_from(f, r["start"], r["end"], r["size"]):
                        next_ = at + np.cumsum([len(x) + 1 for x in lines])
                        begins = np.concatenate([[at], next_[:-1]])
                        n = len(lines)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([r["src"]] * n), pa.array(np.full(n, r["start"])), pa.array(np.arange(count, count + n)), pa.array(begins), pa.array(next_),
                                pa.array(np.full(n, r["size"])), pa.array(lines, pa.binary()),
                            ],
                            [c.split()[0] for c in LINES.split(", ")],
                        )
                        count += n

    return ranges.select("src", "path", "size", "start", "end").mapInArrow(read, LINES)


def _text(lines: DataFrame) -> DataFrame:
    """Lines without carriage returns."""
    return lines.withColumn("raw", F.replace(F.col("raw").cast("string"), F.lit("\r"), F.lit("")))


def head_of_files(spark: SparkSession, path: str | list[str], size: int = 16 << 20, step: int = STEP) -> DataFrame:
    """lines(src, blk, mid, at, raw) that end with a line feed within the first bytes of each file; no further bytes are read but to that line's end."""
    lines = range_lines(split_ranges(list_files(spark, path), 0, F.least("size", F.lit(size)), step))
    return _text(lines.filter(F.col("next") <= F.least("size", F.lit(size)))).select("src", "blk", "mid", "at", "raw")


def tail_of_files(spark: SparkSession, path: str | list[str], size: int = 16 << 20, step: int = STEP) -> DataFrame:
    """lines(src, blk, mid, at, raw) that begin after the first of the last bytes of each file, all lines of a file of no more; only those bytes are read."""
    low = F.greatest(F.col("size") - size, F.lit(0))
    lines = range_lines(split_ranges(list_files(spark, path), low, None, step))
    return _text(lines.filter((F.col("size") <= size) | (F.col("at") > F.col("size") - size))).select("src", "blk", "mid", "at", "raw")


def last_shown(spark: SparkSession, path: str | list[str], shown: Callable[[DataFrame], DataFrame], n: int = 200, step: int = STEP) -> DataFrame:
    """lines(src, at, raw): of each file the last n that shown(lines) keeps, found from the file's end backwards.

    Each round reads twice as many bytes as the one before of those files in which too few lines show yet; what one round found is written to the shared folder.
    At most about twice the bytes are read that hold the lines asked for. at orders a file's lines.
    """
    left = cut(list_files(spark, path).withColumns({"high": F.col("size"), "need": F.lit(n)}), "files")
    found, width = [], step
    while True:
        low = F.greatest(F.col("high") - width, F.lit(0))
        lines = _text(range_lines(split_ranges(left, low, F.col("high"), step))).select("src", "at", "raw")
        found.append(cut(shown(lines).select("src", "at", "raw"), "shown"))
        seen = found[-1].groupBy("src").agg(F.count(F.lit(1)).alias("seen"))
        more = left.join(seen, "src", "left").select("src", "path", "size", low.alias("high"), (F.col("need") - F.coalesce("seen", F.lit(0))).alias("need"))
        more = cut(more.filter("high > 0 AND need > 0"), "files")
        drop(left)
        left = more
        if left.isEmpty():
            break
        width *= 2
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("at")))
    return every.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")
