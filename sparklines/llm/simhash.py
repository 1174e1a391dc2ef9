"""Near-duplicate texts: 64-bit SimHash fingerprints, linked through vantage-point trees.

Two fingerprints at distance k or less, seen in s > k runs of bits, agree in all bits of some s - k of the runs. For each choice of
s - k runs a vantage-point tree parts the fingerprints by the Hamming distance of the chosen bits: within a node's radius
mu of its vantage point, or beyond. The triangle inequality leaves no overlap there, as agreeing bits are equally far from any
vantage point, so each fingerprint goes to one leaf of each tree and the rows dealt grow as the input. In a leaf a tree of
its own parts whole fingerprints: within mu, and beyond mu - k, which two at distance k or less always share; those in the
overlap of the two sides are looked up in both. What can't be parted further is compared exactly.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklines.llm.common import block_pairs, cut, drop, map_groups, merge_labels, small
from sparklines.llm.components import connected_components

PIECE = 1 << 16
#: Fingerprints that are compared with each other rather than parted again.
PLAIN = 256


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles, as a signed 64-bit number.

    A-Z is lower-cased, words are parted by ASCII white space, a bit is set if it is set in more than half of the
    shingles' XXH64. Fewer words than a shingle has: the whole sequence is one. No words or null: 0.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) < words:
        w = [b" ".join(w)]
        shingles = iter(w)
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    n = np.zeros(64, np.int64)
    for a in range(0, len(h), PIECE):
        n += np.unpackbits(h[a : a + PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * n > len(h)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text) as (doc_id, fp)."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in text], dtype="int64")

    return docs.select("doc_id", fp("text").alias("fp"))


def masks(n: int, distance: int, leaf: int) -> list[np.uint64]:
    """Bits that the trees look at: all choices of s - distance of s runs of bits; s is the least for which n fingerprints can fall into leaves of `leaf`."""
    s = distance + 1
    while s < 2 * distance and n > leaf << (64 * (s - distance) // s):
        s += 1
    runs = [sum(1 << int(b) for b in r) for r in np.array_split(np.arange(64), s)]
    return [np.uint64(sum(c)) for c in combinations(runs, s - distance)]


def _split(part: np.ndarray, mask: np.uint64, tries: int, beyond: int) -> tuple[np.uint64, int] | None:
    """(vantage point, mu): of the tries, those that leave least to compare; None if none parts them."""
    best = None
    for v in part[np.linspace(0, len(part) - 1, min(tries, len(part))).astype(int)]:
        n = np.cumsum(np.bincount(np.bitwise_count((part ^ v) & mask), minlength=65)).astype(float)
        far = n[-1] - np.concatenate([np.zeros(beyond + 1), n[: 64 - beyond]])
        cost = n**2 + far**2
        mu = int(np.argmin(cost))
        if best is None or cost[mu] < best[0]:
            best = cost[mu], v, mu
    return (best[1], best[2]) if best and best[0] < 0.9 * len(part) ** 2 else None


class VantageTree:
    """A tree over the bits of a mask, each node with its own vantage point; nodes as arrays: point, mu, first child (0: a leaf)."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, most: int, tries: int = 12):
        """most: fingerprints of the sample that may share a leaf."""
        self.mask, point, mu, child, todo = mask, [0], [0], [0], [(0, sample)]
        while todo:
            node, part = todo.pop()
            split = _split(part, mask, tries, 0) if len(part) > most else None
            if split is None:
                continue
            point[node], mu[node], child[node] = split[0], split[1], len(point)
            d = np.bitwise_count((part ^ split[0]) & mask)
            todo += [(len(point), part[d <= split[1]]), (len(point) + 1, part[d > split[1]])]
            for a in (point, mu, child):
                a += [0, 0]
        self.point, self.mu, self.child = np.array(point, np.uint64), np.array(mu), np.array(child)

    def leaves(self, fp: np.ndarray) -> np.ndarray:
        """The leaf of each fingerprint."""
        node = np.zeros(len(fp), np.int64)
        while len(at := np.flatnonzero(self.child[node])):
            here = node[at]
            far = np.bitwise_count((fp[at] ^ self.point[here]) & self.mask) > self.mu[here]
            node[at] = self.child[here] + far
        return node


def near_pairs(fp: np.ndarray, distance: int, rows: np.ndarray | None = None):
    """(i, j) arrays that together hold every pair at the distance or less: a vantage-point tree over whole fingerprints, walked part by part."""
    todo, all_bits = [np.arange(len(fp)) if rows is None else rows], np.uint64(0xFFFFFFFFFFFFFFFF)
    while todo:
        at = todo.pop()
        part = fp[at]
        split = _split(part, all_bits, 6, distance) if len(at) > PLAIN else None
        if split is not None:
            d = np.bitwise_count(part ^ split[0]).astype(int)
            todo += [at[d <= split[1]], at[d > split[1] - distance]]
            continue
        step = max(1, (1 << 19) // max(1, len(at)))
        for a in range(0, len(at), step):
            i, j = np.nonzero(np.bitwise_count(part[a : a + step, None] ^ part[None, a:]) <= distance)
            yield at[i + a], at[j + a]


def _compare(distance: int):
    def fn(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        fp, rep = fp[order], rep[order]
        labels = np.arange(len(fp))
        for i, j in near_pairs(fp, distance):
            labels = merge_labels(labels, i, j)
        hit = labels != np.arange(len(fp))
        return pa.table({"a": rep[hit], "b": rep[labels[hit]]}) if hit.any() else None

    return fn


def link_near_texts(docs: DataFrame, distance: int = 3, words: int = 3, leaf: int = 1024, sample: int = 1 << 15) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Fingerprints at Hamming distance `distance` (less than 32) or less are linked; component_id is the smallest doc_id
    reachable. leaf: fingerprints aimed at in a leaf; it sets the trees' sizes and how many there are (four up to 65,536 leaves,
    then ten, then twenty). sample: at most so many fingerprints, those with the least hashes, grow the trees on the driver; any sample
    finds all links. A leaf that holds far more is dealt again by the bits its tree looks at, which never parts a pair;
    what agrees in all of them is compared in blocks.

    Null, empty or wordless texts have fingerprint 0 and are linked like others. Rows without an id come back with
    their fingerprint and a null component. Rows that repeat an id are one node. Empty table: no rows.
    """
    prints = cut(with_fingerprints(docs, words), "prints")
    distinct = cut(prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    n = distinct.count()
    first = distinct.filter(F.xxhash64("fp") <= min(2**63 - 1, int(-(2**63) + 2**64 * 0.9 * sample / max(n, 1)))).limit(sample)
    first = np.sort(np.array([r[0] for r in first.select("fp").collect()], np.int64).view(np.uint64))
    most = max(8, leaf * len(first) // max(n, 1))
    trees = [VantageTree(first, m, most) for m in masks(n, distance, leaf)]
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def dealt(batches):
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
            for k, tree in enumerate(shared.value):
                at = tree.leaves(fp) * len(shared.value) + k
                yield pa.RecordBatch.from_pydict({"leaf": at, "bits": (fp & tree.mask).view(np.int64), "fp": fp.view(np.int64), "rep": rep})

    spread = cut(distinct.mapInArrow(dealt, "leaf long, bits long, fp long, rep long"), "leaves")
    cap = 8 * leaf
    heavy = cut(spread.groupBy("leaf").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > cap), "heavy")
    heavy = small(heavy, heavy.count())
    parts = F.coalesce(F.ceil(F.col("_n") / leaf), F.lit(1))
    again = F.pmod(F.xxhash64(F.lit(5), "bits"), parts)
    keyed = spread.join(heavy, "leaf", "left").withColumn("leaf", F.xxhash64("leaf", again)).drop("_n", "bits")
    grouped = block_pairs(keyed, "leaf", "fp", cap)
    edges = map_groups(grouped, ["leaf", "bi", "bj"], _compare(distance), "a long, b long")
    # ids that repeat join the fingerprints they carry
    again = prints.filter("doc_id IS NOT NULL").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    repeated = again.groupBy("a").agg(F.min("b").alias("_b"), F.max("b").alias("_c")).filter("_b <> _c").select("a")
    repeated = again.join(repeated, "a")
    parts = connected_components(edges.unionByName(repeated))
    drop(spread)
    classes = distinct.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = prints.join(classes, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
