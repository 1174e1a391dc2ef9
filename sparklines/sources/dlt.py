"""Binary diagnostic log files and streams: framing in Python, one row for each message, decoding in columns."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklines.functions.dlt import clock_stamp, loose_payload, message_line, name4, storage_stamp
from sparklines.sources.ranges import STEP, list_files, open_file, split_ranges

MAGIC = b"DLT\x01"
FRAMES = "src string, line_idx long, layout string, seconds long, micros long, ecu binary, app binary, ctx binary, msg binary"


def layout_of(data: bytes) -> str | None:
    """storage (own header before each message), simple (names in the header) or wire (messages alone)."""
    if data[:4] == MAGIC:
        names = data[4:16]
        return "simple" if len(data) >= 22 and all(b == 0 or 0x20 <= b <= 0x7E for b in names) else "storage"
    size = int.from_bytes(data[2:4], "big")
    return "wire" if _wire_ok(data) and size < len(data) and _wire_ok(data[size:]) else None


def _wire_ok(data: bytes) -> bool:
    if len(data) < 4 or data[0] & 0xE0 != 0x20 or not data[0] & 1:
        return False
    size = int.from_bytes(data[2:4], "big")
    ext = 4 + 4 * sum(bool(data[0] & bit) for bit in (0x04, 0x08, 0x10))
    if not max(4, ext + 10) <= size <= len(data) or data[ext] >> 1 & 7 > 3:
        return False
    names = (data[4:8] if data[0] & 0x04 else b"") + data[ext + 2 : ext + 10]
    return all(b == 0 or chr(b).isalnum() and b < 128 or b in b"_-" for b in names)


#: Bytes before a message's own header, and bytes of the longest message with them.
HEAD, LONGEST = {"storage": 16, "simple": 22, "wire": 0}, 0xFFFF + 22


class Walk:
    """The walk from message to message over bytes [base, base + len(data)) of a file of `size` bytes; all places are the file's."""

    def __init__(self, data: bytes, layout: str | None, base: int = 0, size: int | None = None):
        self.data, self.layout, self.base, self.size = data, layout, base, len(data) if size is None else size

    def settle(self, at: int) -> int:
        """The first magic from a place on, where there are magics; -1 if these bytes hold none."""
        if self.layout == "wire":
            return at
        found = self.data.find(MAGIC, at - self.base)
        return self.base + found if found >= 0 else -1

    def step(self, at: int) -> tuple[int, int, bool]:
        """(start of the message at a settled place, place after it, whether it is one); after -1 the walk is over, after a bad message the search goes on."""
        i, head = at - self.base, HEAD[self.layout]
        start = at + head
        if self.layout == "wire":
            if at + 4 > self.size or self.data[i] & 0xE0 != 0x20:
                return at, -1, False
            n = int.from_bytes(self.data[i + 2 : i + 4], "big")
            return (at, at + n, True) if n >= 4 and at + n <= self.size else (at, -1, False)
        if start > self.size or self.layout == "storage" and start + 4 > self.size:
            return at, -1, False
        at_size = i + (18 if self.layout == "storage" else 20)
        n = int.from_bytes(self.data[at_size : at_size + 2], "big")
        if (n < 4 and self.layout == "storage") or start + n > self.size:
            return at, at + 1, False
        return start, start + n, True

    def rows(self, at: int, end: int) -> Iterator[tuple]:
        """(layout, seconds, micros, ecu, app, ctx, message) of the messages whose heads lie in [at, end)."""
        while 0 <= at < end and (at := self.settle(at)) >= 0 and at < end:
            start, after, good = self.step(at)
            if good:
                i, d = at - self.base, self.data
                message = d[start - self.base : after - self.base]
                if self.layout == "wire":
                    yield "wire", None, None, None, None, None, message
                elif self.layout == "storage":
                    yield "storage", int.from_bytes(d[i + 4 : i + 8], "little"), int.from_bytes(d[i + 8 : i + 12], "little"), d[i + 12 : i + 16], None, None, message
                else:
                    yield "simple", int.from_bytes(d[i + 16 : i + 20], "big"), 0, d[i + 4 : i + 8], d[i + 8 : i + 12], d[i + 12 : i + 16], message
            at = after

    def ends(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """(entry, exit, messages) for every settled place at which a walk may enter [start, end); without magics, for those where a message is.

        Entries are all places within a longest message from the start (the first beyond it too); a walk leaves at its first place from end on, or
        with -1 when it is over. Walks that meet stay together, so each goes on only to a place where another has been.
        """
        seen: dict[int, tuple[int, int]] = {}
        out, at = [], start
        while at < end:
            entry = self.settle(at)
            if entry < 0 or entry >= end:
                break
            path, here = [], entry
            while 0 <= here < end and here not in seen:
                _, after, good = self.step(here)
                path.append((here, good))
                here = after if after < 0 else self.settle(after) if after < end else after
                if here < 0 <= after:  # no magic is left here
                    here = end
            leave, count = seen[here] if here in seen else (here, 0)
            for place, good in reversed(path):
                count += good
                seen[place] = leave, count
            if self.layout != "wire" or seen[entry] != (-1, 0):  # most places of a file without magics are no message
                out.append((entry, *seen[entry]))
            at = entry + 1
            if at > start + LONGEST:
                break
        return out


def frames(data: bytes, layout: str | None = None) -> Iterator[tuple]:
    """(layout, seconds, micros, ecu, app, ctx, message) of each message; after a bad length on to the next magic."""
    layout = layout or layout_of(data)
    return Walk(data, layout).rows(0, len(data)) if layout else iter(())


_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in FRAMES.split(", ")]


#: Rows and bytes of messages of a batch.
ROWS, BYTES = 10_000, 8 << 20


def _batches(framed: Iterator[tuple[str, int, Iterator[tuple]]]) -> Iterator[pa.RecordBatch]:
    """Rows of FRAMES of (src, first number, frames), some at a time; many small contents share a batch, which costs far more than a message."""
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _TYPES, strict=True)], _NAMES)
    for src, first, rows in framed:
        for i, f in enumerate(rows, first):
            held.append((src, i, *f))
            size += len(f[-1])
            if len(held) >= ROWS or size >= BYTES:
                yield batch()
                held, size = [], 0
    if held:
        yield batch()


def frame_messages(files: DataFrame) -> DataFrame:
    """A row for each message of files(src, content), numbered by place; each content is framed whole, as records of streams are. See scan_messages() for files."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = ((src, data.as_py() or b"") for batch in batches for src, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        yield from _batches((src, 0, frames(data)) for src, data in contents)

    return files.select("src", "content").mapInArrow(framed, FRAMES)


def _read(path: str, start: int, end: int, size: int) -> bytes:
    """Bytes from start to a longest message beyond end."""
    with open_file(path) as f:
        f.seek(start)
        return f.read(min(size, end + LONGEST + 4) - start)


def scan_messages(files: DataFrame, step: int = STEP) -> DataFrame:
    """A row for each message of files(src, path, size), numbered by place: ranges of step bytes are read at once, files of any size.

    Where a range's first message begins depends on what came before. So each range first tells, for every place at which a walk may enter it, where that
    walk leaves it and how many messages it meets; following these from range to range, a few numbers each, gives every range's true entry and its first number. Then the
    ranges are read again for their messages. The rows are those of one walk over the whole file, wrong magics within messages and bad lengths included.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = _read(r["path"], r["start"], r["end"], r["size"])
                ends = Walk(data, r["layout"], r["start"], r["size"]).ends(r["start"], r["end"])
                entries, leaves, counts = zip(*ends, strict=True) if ends else ((), (), ())
                yield pa.RecordBatch.from_pylist([r | {"entries": list(entries), "leaves": list(leaves), "counts": list(counts)}], schema=known)

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, at, number = None, 0, 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["src"] != src:
                    src, at, number = r["src"], 0, 0
                if not 0 <= at < r["end"]:
                    continue
                k = bisect_left(r["entries"], at)
                if k == len(r["entries"]) or r["layout"] == "wire" and r["entries"][k] != at:
                    at = -1 if r["layout"] == "wire" else r["end"]
                    continue
                rows.append({n: r[n] for n in entry.names[:-2]} | {"entry": at, "number": number})
                at, number = r["leaves"][k], number + r["counts"][k]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=entry)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = (r for batch in batches for r in batch.to_pylist())
        walk = lambda r: Walk(_read(r["path"], r["start"], r["end"], r["size"]), r["layout"], r["start"], r["size"])
        yield from _batches((r["src"], r["number"], walk(r).rows(r["entry"], r["end"])) for r in ranges)

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layouts = [layout_of(_read(p, 0, min(n, LONGEST), n)) for p, n in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True)]
            yield batch.append_column("layout", pa.array(layouts, pa.string()))

    files = files.select("src", "path", "size").filter("size > 0")
    spread = files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, 8))
    ranges = split_ranges(spread.mapInArrow(laid_out, "src string, path string, size long, layout string").filter("layout IS NOT NULL"), step=step)
    place = [("src", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("layout", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    known, entry = (pa.schema([*place, *more]) for more in ([(c, pa.list_(pa.int64())) for c in ("entries", "leaves", "counts")], [("entry", pa.int64()), ("number", pa.int64())]))
    text = "src string, path string, size long, layout string, start long, end long"
    tables = ranges.select("src", "path", "size", "layout", "start", "end").mapInArrow(told, text + ", entries array<long>, leaves array<long>, counts array<long>")
    begun = tables.repartition("src").sortWithinPartitions("src", "start").mapInArrow(entered, text + ", entry long, number long")
    return begun.repartition(max(files.sparkSession.sparkContext.defaultParallelism, 8)).mapInArrow(framed, FRAMES)


def decode_messages(messages: DataFrame, received: Column | None = None) -> DataFrame:
    """lines(src, line_idx, raw) of framed messages in the text form; received: stamp for messages without a date."""
    stamp = F.when(F.col("seconds").isNotNull(), storage_stamp(F.col("seconds"), F.col("micros"))).otherwise(received if received is not None else clock_stamp(F.col("msg")))
    simple = F.concat_ws(" ", stamp, F.lit("0 000"), name4(F.col("ecu")), name4(F.col("app")), name4(F.col("ctx")), F.lit("log info non-verbose 0"), loose_payload(F.col("msg")))
    ecu = F.when(F.col("ecu").isNotNull(), name4(F.col("ecu")))
    raw = F.when(F.col("layout") == "simple", simple).otherwise(message_line(F.col("msg"), stamp, ecu))
    # a generated row holds the text as a value; a filter alone would decode a message twice
    return messages.select("src", "line_idx", F.explode(F.array(raw)).alias("raw")).filter("raw IS NOT NULL")


def read_dlt(spark: SparkSession, path: str | list[str], step: int = STEP) -> DataFrame:
    """Text lines of binary diagnostic log files, read in ranges of step bytes."""
    return decode_messages(scan_messages(list_files(spark, path), step))
