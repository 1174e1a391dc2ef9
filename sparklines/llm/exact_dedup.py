"""Exact dedup through an extendible-hash index whose buckets are files in the shared folder.

The directory maps the leading bits of a text's hash to buckets. It starts with one bucket; an overfull
bucket is split by its next bit, and the directory doubles when that bucket is already as deep as the
directory. Owner tasks each take a range of buckets (hot hashes a salt range of one), chain the different texts that share a hash and
compare their bytes, and each writes its entries, in order of buckets, as one of the index files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklines.llm.common import cut, small


def build_directory(cells: dict[int, int], cell_bits: int, capacity: int) -> tuple[int, list[int]]:
    """(global depth, bucket of each directory entry) such that no bucket that can still split holds over capacity.

    cells: number of distinct hashes by their leading cell_bits bits. A bucket is named by its first cell.
    """
    load = np.zeros((1 << cell_bits) + 1, np.int64)
    for cell, n in cells.items():
        load[cell + 1] = n
    load = np.cumsum(load)
    depth, done, todo = 0, [], [(0, 0)]
    while todo:
        prefix, local = todo.pop()
        width = 1 << (cell_bits - local)
        if local < cell_bits and load[(prefix + 1) * width] - load[prefix * width] > capacity:
            todo += [(2 * prefix, local + 1), (2 * prefix + 1, local + 1)]
            depth = max(depth, local + 1)
        else:
            done.append((prefix, local))
    directory = [0] * (1 << depth)
    for prefix, local in done:
        span = 1 << (depth - local)
        directory[prefix * span : (prefix + 1) * span] = [prefix << (cell_bits - local)] * span
    return depth, directory


def _lead(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, h, salt): the chain of different texts of one (h, salt) in memory at a time."""
    at, chain, latest = None, [], 0
    for batch in batches:
        slot, sha, text_at, first = [], [], batch.schema.get_field_index("text"), []
        for key, text in zip(zip(batch.column("h").to_pylist(), batch.column("salt").to_pylist(), strict=True), batch.column(text_at).to_pylist(), strict=True):
            if key != at:
                at, chain = key, []
            latest = next((i for i, (other, _) in enumerate(chain) if other == text), -1)
            first.append(latest < 0)
            if latest < 0:
                latest = len(chain)
                chain.append((text, hashlib.sha256(text).hexdigest()))
            slot.append(latest)
            sha.append(chain[latest][1])
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        cols |= {"slot": pa.array(slot, pa.int64()), "text_sha256": pa.array(sha, pa.string()), "lead": pa.array(first, pa.bool_())}
        yield pa.RecordBatch.from_pydict(cols)


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each chain's texts."""
    for batch in _chains(batches):
        yield batch.filter(batch.column("lead"))


def _directory(docs: DataFrame, columns: list[str] | None, cell_bits: int, capacity: int, hot: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their hashes and buckets, hashes of over `hot` rows and among how many owners they are dealt, how many such hashes)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    seen = docs.select(h.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    seen = cut(seen, "hashes")
    cell_bits = min(cell_bits, max(0, ceil(log2(max(seen.count(), 1) / capacity)) + 4))
    cells = {r[0]: r[1] for r in seen.groupBy(_lead(F.col("h"), cell_bits).alias("cell")).count().collect()}
    depth, directory = build_directory(cells, cell_bits, capacity)
    heavy = seen.filter(F.col("n") > hot).select("h", F.ceil(F.col("n") / hot).cast("int").alias("owners"))
    spark = docs.sparkSession
    lookup = spark.createDataFrame(list(enumerate(directory)), "lead int, bucket int")  # at most 2 ** cell_bits rows
    carried = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[F.col(c) for c in columns if c != "text"]).alias("row")) if columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", text.alias("text"), h.alias("h"), carried.alias("row"))
    return rows.withColumn("lead", _lead(F.col("h"), depth)).join(F.broadcast(lookup), "lead").drop("lead"), heavy, heavy.count()


def _chained(rows: DataFrame, columns: list[str] | None, chains: Callable = _chains) -> DataFrame:
    """Rows with their owners, in chains of equal texts."""
    rows = rows.withColumn("salt", F.when(F.col("owners").isNotNull(), F.pmod(F.xxhash64(F.lit(3), "doc_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())), F.col("owners"))).otherwise(F.lit(0)).cast("int"))
    owned = rows.repartitionByRange("bucket", "salt").sortWithinPartitions("bucket", "h", "salt", F.desc_nulls_last("doc_id"))
    schema = T.StructType(list(owned.schema.fields)).add("slot", "long").add("text_sha256", "string").add("lead", "boolean")
    entries = owned.mapInArrow(chains, schema)
    if columns:  # the text itself travels once
        own = F.when(~F.col("row.no_text"), F.col("text").cast("string"))
        entries = entries.withColumn("row", F.struct(*[(own if c == "text" else F.col("row.row")[c]).alias(c) for c in columns]))
    return entries


def kept_rows(docs: DataFrame, columns: list[str], cell_bits: int = 20, capacity: int = 1024, hot: int = 1024) -> DataFrame:
    """The columns of the rows of docs that exact_dedup() keeps; no index is written and a text moves once.

    The first row of a chain that one owner built stays as it is. Only first rows of the chains of dealt hashes, one for each owner, meet again.
    """
    rows, heavy, dealt = _directory(docs, columns, cell_bits, capacity, hot)
    if not dealt:
        return _chained(rows.withColumn("owners", F.lit(None).cast("int")), columns, _leads).select("row.*")
    heavy = small(heavy, dealt)
    alone = rows.join(heavy.select("h"), "h", "left_anti").withColumn("owners", F.lit(None).cast("int"))
    spread = _chained(rows.join(heavy, "h"), columns, _leads)
    last = F.max_by("row", F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("salt")))
    spread = spread.groupBy("h", "text").agg(last.alias("row"))
    return _chained(alone, columns, _leads).select("row.*").unionByName(spread.select("row.*"))


def exact_dedup(docs: DataFrame, columns: list[str] | None = None, cell_bits: int = 20, capacity: int = 1024, hot: int = 1024) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    Texts are equal when their UTF-8 bytes are; null counts as empty. Of equal texts the row with the
    largest id stays (a null id is below all others; of rows that repeat the id as well, one stays).
    columns: further columns of docs that come along as the struct `row`. capacity: different hashes in a
    bucket that doesn't split; the directory is built from counts over cells of the leading bits, about 16 for
    each bucket, 2 ** cell_bits at most. A hash of over `hot` rows is dealt by the
    id over several owners, whose chains then meet with one text for each owner. Empty table: no rows.
    """
    rows, heavy, dealt = _directory(docs, columns, cell_bits, capacity, hot)
    entries = _chained(rows.join(small(heavy, dealt), "h", "left"), columns)
    dealt = F.col("owners").isNotNull()
    index = entries.select(
        "bucket", "h", "salt", "slot", "doc_id", "lead", "text_sha256", *(["row"] if columns else []),
        F.when(dealt & F.col("lead"), F.col("text")).alias("text"), F.when(dealt, F.lit(-1)).otherwise(F.col("slot")).alias("chain"),
    )
    return _merge(cut(index, "index"), bool(columns))


def _merge(index: DataFrame, carry: bool) -> DataFrame:
    """Chains of one hash that several owners built become one: their leading texts are compared by bytes."""
    owner = index.groupBy("h", "salt", "slot", "chain").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("lead"), F.col("text"))).alias("text")
    )
    group = owner.groupBy("h", "chain", F.coalesce("text", F.lit(b"")).alias("text")).agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"),
        F.max_by(F.struct("salt", "slot"), F.struct(F.col("top").isNotNull(), "top", -F.col("salt"))).alias("at"),
    )
    owner = owner.select("h", "salt", "slot", "chain", F.coalesce("text", F.lit(b"")).alias("text")).join(group, ["h", "chain", "text"])
    owner = owner.drop("chain", "text")
    out = index.drop("chain", "text").join(owner, ["h", "salt", "slot"])
    kept = F.col("lead") & (F.col("at.salt") == F.col("salt")) & (F.col("at.slot") == F.col("slot"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256", *(["row"] if carry else []))
