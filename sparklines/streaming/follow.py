"""Following files that grow, as streaming sources.

`follow` finds each file's last line feed and counts lines on the driver, for logs that grow slowly. `follow_ranges` only asks for sizes there:
its readers find line starts themselves, over many ranges of a large file at once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "src string, line_idx long, raw string, rotation int"
PIECE = 1 << 20


def _last_feed(path: str, low: int, high: int) -> int:
    """Bytes up to and with the last line feed in [low, high), read backwards in pieces; low if there is none."""
    with open(path, "rb") as f:
        while high > low:
            a = max(low, high - PIECE)
            f.seek(a)
            at = f.read(high - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            high = a
    return low


def _feeds(path: str, low: int, high: int) -> int:
    n = 0
    with open(path, "rb") as f:
        f.seek(low)
        while low < high:
            data = f.read(min(PIECE, high - low))
            if not data:
                break
            n, low = n + data.count(b"\n"), low + len(data)
    return n


class _Part(InputPartition):
    def __init__(self, path: str, low: int, high: int, first: int, rotation: int):
        self.path, self.low, self.high, self.first, self.rotation = path, low, high, first, rotation


class FollowReader(DataSourceStreamReader):
    """Offsets: {path: [bytes, lines, rotation]}. A file that shrinks starts anew from its new size, one rotation on."""

    def __init__(self, path: str, start: str):
        self.path, self.start = path, start
        self.seen: dict[str, list[int]] | None = None

    def _files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(e.path for e in os.scandir(self.path) if e.is_file() and not e.name.startswith("."))
        return [self.path] if os.path.exists(self.path) else []

    def initialOffset(self) -> dict:
        if self.start == "end":
            at = {p: _last_feed(p, 0, os.path.getsize(p)) for p in self._files()}
            return {p: [n, _feeds(p, 0, n), 0] for p, n in at.items()}
        return {}

    def latestOffset(self) -> dict:
        seen, new = self.seen or self.initialOffset(), {}
        for p in self._files():
            low, lines, turn = seen.get(p, [0, 0, 0])
            size = os.path.getsize(p)
            if size < low:
                low, lines, turn = size, lines, turn + 1
            high = _last_feed(p, low, size)
            new[p] = [high, lines + _feeds(p, low, high), turn]
        self.seen = {**seen, **new}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = self.seen or end
        parts = []
        for p, (high, _, turn) in end.items():
            low, first, was = start.get(p, [0, 0, 0])
            if turn > was:
                low = min(low, high)
            if high > low:
                parts.append(_Part(p, low, high, first, turn))
        return parts

    def read(self, part: InputPartition) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.low)
            left, number = part.high - part.low, part.first
            while left > 0:
                line = f.readline(left)
                if not line:
                    return
                left -= len(line)
                yield part.path, number, line.rstrip(b"\n").replace(b"\r", b"").decode("utf-8", "replace"), part.rotation
                number += 1

    def commit(self, end: dict) -> None:
        pass


class FollowSource(DataSource):
    """format("follow"): options path, start (`beginning` or `end`). All executors must see the path."""

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FollowReader(self.options["path"], self.options.get("start", "beginning"))


def follow_files(spark: SparkSession, path: str, start: str = "beginning") -> DataFrame:
    """Streaming lines(src, line_idx, raw, rotation) of a file or a flat directory, also of bytes appended later."""
    spark.dataSource.register(FollowSource)
    return spark.readStream.format("follow").option("path", path).option("start", start).load()


RANGES = "src string, rotation int, blk long, mid long, at long, raw binary"

#: Bytes that opening a range counts for when partitions take several ranges, bytes of such a partition, the fewest partitions there are then, and lines handed on at once.
OPENING, SHARE, LEAST, LINES = 64 << 10, 32 << 20, 64, 1 << 16


class _Range(NamedTuple):
    path: str
    low: int
    high: int
    base: int
    rotation: int


class _Ranges(InputPartition):
    def __init__(self, ranges: list[_Range]):
        self.ranges = ranges


def _together(ranges: list[_Range]) -> list[InputPartition]:
    """Partitions of one range each, of several if there are many small ones: a task costs far more than a small file."""
    cost = [OPENING + r.high - r.low for r in ranges]
    share, parts, held = min(SHARE, sum(cost) / LEAST), [], 0
    for r, c in zip(ranges, cost, strict=True):
        if not parts or held + c > share:
            parts.append([])
            held = 0
        parts[-1].append(r)
        held += c
    return [_Ranges(p) for p in parts]


class RangeReader(DataSourceStreamReader):
    """Offsets: {path: [size, base, rotation]}, from the files' sizes alone. A file that shrinks goes on from its new size, its base, one rotation on.

    A line belongs to the range that its line feed lies in; the range's reader looks for the line's start before the range, down to the base at most.
    """

    def __init__(self, path: str, start: str, piece: int, limit: int):
        self.path, self.start, self.piece, self.limit = path, start, piece, limit
        self.seen: dict[str, list[int]] | None = None

    def _files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(e.path for e in os.scandir(self.path) if e.is_file() and not e.name.startswith("."))
        return [self.path] if os.path.exists(self.path) else []

    def initialOffset(self) -> dict:
        return {p: [os.path.getsize(p), 0, 0] for p in self._files()} if self.start == "end" else {}

    def latestOffset(self) -> dict:
        seen, left = dict(self.initialOffset() if self.seen is None else self.seen), self.limit
        for p in self._files():
            low, base, turn = seen.get(p, [0, 0, 0])
            size = os.path.getsize(p)
            if size < low:
                low, base, turn = size, size, turn + 1
            more = size - low if self.limit <= 0 else min(size - low, left)
            left -= more
            seen[p] = [low + more, base, turn]
        self.seen = seen
        return seen

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = end if self.seen is None else self.seen
        ranges = []
        for p, (high, base, turn) in end.items():
            low, _, was = start.get(p, [0, 0, 0])
            low = low if turn == was else base
            ranges += [_Range(p, a, min(high, a + self.piece), base, turn) for a in range(low, high, self.piece)]
        return _together(ranges)

    def read(self, part: _Ranges) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for r in part.ranges:
            for batch in self._lines(r):
                held.append(batch)
                rows += batch.num_rows
                if rows >= LINES:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _lines(self, part: _Range) -> Iterator[pa.RecordBatch]:
        at = _last_feed(part.path, part.base, part.low) if part.base < part.low else part.low  # after the last line feed before the range
        with open(part.path, "rb") as f:
            f.seek(at)
            held, mid = b"", 0
            while True:
                data = f.read(min(PIECE, part.high - at - len(held)))
                if not data:
                    return
                lines = (held + data).split(b"\n")
                held = lines.pop()
                if not lines:
                    continue
                n, next_ = len(lines), at + np.cumsum([len(x) + 1 for x in lines])
                begins = np.concatenate([[at], next_[:-1]])
                at = int(next_[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.path] * n), pa.array([part.rotation] * n, pa.int32()), pa.array([part.low] * n, pa.int64()), pa.array(np.arange(mid, mid + n)),
                        pa.array(begins), pa.array([x.replace(b"\r", b"") for x in lines], pa.binary()),
                    ],
                    [c.split()[0] for c in RANGES.split(", ")],
                )
                mid += n

    def commit(self, end: dict) -> None:
        pass


class RangeSource(DataSource):
    """format("follow_ranges"): options path, start (`beginning` or `end`), piece (bytes of a partition), limit (bytes of a batch, 0 for all). All executors must see the path."""

    @classmethod
    def name(cls) -> str:
        return "follow_ranges"

    def schema(self) -> str:
        return RANGES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RangeReader(self.options["path"], self.options.get("start", "beginning"), int(self.options.get("piece", 32 << 20)), int(self.options.get("limit", 0)))


def follow_ranges(spark: SparkSession, path: str, start: str = "beginning", piece: int = 32 << 20, limit: int = 0) -> DataFrame:
    """Streaming lines(src, rotation, blk, mid, at, raw) of a file or a flat directory, also of bytes appended later; at is the place of a line's first byte.

    jobs.write_numbered() gives them line_idx. limit bounds the bytes that a batch adds; leave it 0 for runs with availableNow, which take one batch.
    """
    spark.dataSource.register(RangeSource)
    stream = spark.readStream.format("follow_ranges").option("path", path).option("start", start).option("piece", piece).option("limit", limit).load()
    return stream.withColumn("raw", F.col("raw").cast("string"))
