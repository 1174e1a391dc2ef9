"""Whole texts whose sets of word shingles are similar: MinHash bands propose, exact Jaccard confirms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklines.llm.common import block_pairs, cut, drop, map_groups, parted, slices
from sparklines.llm.paragraph_dedup import _linked, line_keys
from sparklines.llm.words import band_keys, shingle_hashes, word_tables

#: Shingles hashed into bands at once.
PIECE = 1 << 16


def similar_texts(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 8, rows: int = 2, cap: int = 1024) -> DataFrame:
    """Links (a, b) between the ids of docs(doc_id, text) whose texts have a Jaccard similarity of threshold or more.

    Components of the links are those of all such pairs; within a group of similar texts only some are given. Two texts at 0.8 share one of
    the default bands with a probability of 0.9997. Texts without words and rows without an id have no links.
    """
    rows_of = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")

    def signed(batches):
        def batch_of(held):
            doc_id, k1, k2, shingles = zip(*held, strict=True)
            starts = np.cumsum([0, *(len(x) for x in shingles[:-1])])
            keys = band_keys(np.concatenate(shingles), starts, bands, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_id, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "bands": lists})

        for batch in (some for b in batches for some in slices(b, 1)):
            held, size = [], 0
            for doc_id, (_, _, hashes, _) in zip(batch.column(0).to_pylist(), word_tables(batch.column(1).to_pylist()), strict=True):
                if len(hashes):
                    held.append((doc_id, *(int(k[0]) for k in line_keys(hashes, np.zeros(1, np.int64))), shingle_hashes(hashes, words)))
                    size += len(hashes)
                if size > PIECE:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    found = cut(rows_of.mapInArrow(signed, "doc_id long, k1 long, k2 long, bands array<long>"), "signed")
    distinct = found.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    banded = distinct.select("id", "rep", F.explode("bands").alias("band"))
    ident = F.xxhash64(F.lit(9), "id")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(ident).alias("x"), F.min(ident).alias("low")).filter("n > 1")
    shared = cut(shared.groupBy("n", "x", "low").agg(F.min("band").alias("band")).select("band"), "shared")  # of bands with the same members one
    asked = cut(banded.join(shared, "band"), "asked")
    need = distinct.join(asked.select("id").distinct(), "id").select(F.col("rep").alias("doc_id"), "id", "k1", "k2")
    need = cut(need, "need")

    def fetched(batches):
        for batch in (some for b in batches for some in slices(b, 0)):
            ids, sets = [], []
            text, *asked_for = (c.to_pylist() for c in batch.columns)
            for (_, _, hashes, _), i, *keys in zip(word_tables(text), *asked_for, strict=True):
                if len(hashes) and [int(k[0]) for k in line_keys(hashes, np.zeros(1, np.int64))] == keys:
                    ids.append(i)
                    sets.append(np.unique(shingle_hashes(hashes, words)).tobytes())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "shingles": pa.array(sets, pa.binary())})

    some, _ = parted(rows_of, "doc_id", need, need.count())
    texts = some.join(need, "doc_id").select("text", "id", "k1", "k2").mapInArrow(fetched, "id long, shingles binary")
    texts = cut(texts.groupBy("id").agg(F.first("shingles").alias("shingles")).withColumn("bytes", F.octet_length("shingles")), "shingles")

    def verified(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        across = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        root, rep = _linked(sets, threshold, t.column("side").to_numpy(), across), t.column("rep").to_numpy()
        hit = root != np.arange(len(root))
        return pa.table({"a": rep[hit], "b": rep[root[hit]]}) if hit.any() else None

    pairs = map_groups(block_pairs(asked.join(texts, "id"), "band", "id", cap, "bytes"), ["band", "bi", "bj"], verified, "a long, b long")
    same = found.select("doc_id", "k1", "k2").join(distinct.select("k1", "k2", "rep"), ["k1", "k2"]).filter("doc_id <> rep")
    links = cut(pairs.unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))), "links")
    for done in (found, distinct, shared, asked, need, texts):
        drop(done)
    return links
