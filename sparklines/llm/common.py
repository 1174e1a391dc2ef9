"""Shared pieces: groups walked in bounded blocks, hints within a bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklines.shared import checkpoint_root, cut, drop  # noqa: F401 (for the operators)

#: Most bytes of a table that is given a broadcast hint; beyond it Spark picks the join.
BROADCAST_BYTES = 4 << 20


def small(df: DataFrame, rows: int, width: int = 80) -> DataFrame:
    """With a broadcast hint if the counted rows, of about width bytes each, allow it."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


#: Bits of parted()'s bitmap for each id, and in all.
ID_BITS, MOST_BITS = 16, 1 << 25


def parted(df: DataFrame, key: str, ids: DataFrame, rows: int, most: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be among ids, rows whose key isn't), without moving a row of df.

    A bitmap of the ids' hashes is broadcast, at most `most` bits (4 MB) of it. About one other row in 17 counts among
    those that may be, more where rows x ID_BITS is beyond the most: join them with ids for the exact answer.
    """
    bits = 1 << 15
    while bits < min(rows * ID_BITS, most):
        bits *= 2
    slot = lambda c: F.pmod(F.xxhash64(F.lit(11), c), F.lit(bits))
    at = ids.select(slot(F.col(key)).alias("_p"))
    maps = at.groupBy(F.shiftright("_p", 15).alias("_k")).agg(F.bitmap_construct_agg(F.col("_p").bitwiseAND(F.lit((1 << 15) - 1))).alias("_bits"))
    maps = F.broadcast(cut(maps, "bitmaps"))
    place = slot(df[key]).bitwiseAND(F.lit((1 << 15) - 1))
    byte = F.conv(F.hex(F.substring(maps["_bits"], F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = (F.shiftright(slot(df[key]), 15) == maps["_k"]) & (F.bit_get(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1)
    return df.join(maps, met, "left_semi"), df.join(maps, met, "left_anti")


#: Bytes of text that a worker turns into objects at once.
TEXT_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in that column take at most so many bytes, or of one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def unit_draw(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns' text and the seed alone; 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


#: Most bytes of a block of block_pairs() whose rows carry their size.
BLOCK_BYTES = 32 << 20


def block_pairs(entries: DataFrame, key: str, ident: str, cap: int, size: str | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """Add bi, bj, side so that groups of (key, bi, bj) hold at most about 2 x cap rows and, by the column size, 2 x most bytes.

    A key of up to cap rows and most bytes is one group (0, 0). A larger one is dealt over s blocks by the hash of
    ident, and each row goes to the s groups that pair its block with another or itself: every two
    rows of a key meet in exactly one group that compares them.
    """
    blocks = F.ceil(F.count(F.lit(1)) / cap)
    if size:
        blocks = F.greatest(blocks, F.ceil(F.sum(size) / most))
    heavy = cut(entries.groupBy(key).agg(blocks.cast("int").alias("_s")).filter(F.col("_s") > 1), "heavy")
    rows = heavy.count()
    if not rows:
        return entries.select("*", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side"))
    dealt = entries.join(small(heavy, rows), key, "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(F.lit(7), F.col(ident)), F.col("_s")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    return dealt.withColumns({"bi": F.least("side", "_o"), "bj": F.greatest("side", "_o")}).drop("_s", "_o")


def map_sorted(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str) -> DataFrame:
    """fn(table, starts) over rows in order of keys (longs or ints, never null), whole groups only, many small ones at a time.

    starts: where each group begins, with the number of rows at the end. Like applyInPandas, but groups of a few rows cost
    microseconds. Bound the groups with block_pairs().
    """
    parted = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            new = np.zeros(table.num_rows, bool)
            for k in keys:
                v = table.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.concatenate([[0], np.flatnonzero(new)])
            if len(starts) > 1:
                for out in fn(table.slice(0, starts[-1]), starts):
                    yield from out.to_batches()
            held = table.slice(starts[-1])
        if held is not None:
            for out in fn(held, np.array([0, held.num_rows])):
                yield from out.to_batches()

    return parted.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """fn over each group of equal keys, one at a time; see map_sorted()."""

    def each(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            if (out := fn(table.slice(a, b - a))) is not None:
                yield out

    return map_sorted(df, keys, each, schema)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b) into labels, each node's smallest linked node so far."""
    while True:
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return labels
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
