"""Near-duplicate vectors through spherical-cap filters.

Directions are structured: the space is cut into blocks of coordinates and a direction joins one random
code word of each block (a random product code). A vector belongs to all directions whose inner product
with it exceeds alpha; list decoding finds them without trying every direction. Vectors close to each
other share directions with high probability, so vectors that share one are compared exactly. The number of directions follows
the number of vectors, so that a direction's bucket keeps its size, and alpha is set so that a pair at the threshold shares
as many directions as ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklines.llm.common import block_pairs, cut, map_sorted, merge_labels
from sparklines.llm.components import connected_components

#: Rows of a group that are compared pair by pair with those of other small groups.
PLAIN = 24
#: Words of a block, and partial sums, that are tried when alpha is set.
LEADING = 512


def code_words(dim: int, blocks: int, codes: int, seed: int) -> list[np.ndarray]:
    """One (codes, width) array for each block; a word has norm 1/sqrt(blocks), so that directions have norm 1."""
    rng = np.random.default_rng([seed, dim])
    blocks = min(blocks, dim)
    out = []
    for cols in np.array_split(np.arange(dim), blocks):
        w = rng.standard_normal((codes, len(cols)))
        out.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks))
    return out


def list_decode(x: np.ndarray, words: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all directions whose inner product with a row reaches alpha.

    Block by block; a partial direction goes on only if the best words of the blocks left could still
    lift it to alpha.
    """
    at = np.cumsum([0, *(w.shape[1] for w in words)])
    scores = [x[:, a:b] @ w.T for w, a, b in zip(words, at, at[1:], strict=False)]
    best = [s.max(axis=1) for s in scores]
    rest = [np.sum(best[j + 1 :], axis=0) if j + 1 < len(words) else np.zeros(len(x)) for j in range(len(words))]
    row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for s, tail in zip(scores, rest, strict=True):
        grown = total[:, None] + s[row]
        i, j = np.nonzero(grown + tail[row][:, None] >= alpha)
        row, code, total = row[i], code[i] * s.shape[1] + j, grown[i, j]
    return row, code


@lru_cache(maxsize=16)
def cap_bound(dim: int, blocks: int, codes: int, seed: int, shared: float, threshold: float) -> float:
    """alpha for which two vectors at the threshold's cosine share so many directions on average, from 128 seeded pairs.

    Only a direction's far tail matters, and such a direction has words from the tail of every block. So of each block the LEADING words that suit
    a pair best are joined, and of the partial sums as many go on; memory is the square of that at most, however many words there are.
    """
    words, rng = code_words(dim, blocks, codes, seed), np.random.default_rng([seed, dim, 1])
    x, y = rng.standard_normal((2, 128, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = threshold * x + np.sqrt(1 - threshold**2) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    edges = np.cumsum([0, *(w.shape[1] for w in words)])
    parts = [[v[:, a:b] @ w.T for v in (x, y)] for w, a, b in zip(words, edges, edges[1:], strict=False)]
    rank, every, size = int(shared * 128), [], 1
    for k in range(128):
        both = np.zeros((2, 1))
        for part in parts:
            own = np.stack([p[k] for p in part])
            own, both = (s[:, np.argsort(-s.sum(axis=0), kind="stable")[:LEADING]] for s in (own, both))
            both = (both[:, :, None] + own[:, None, :]).reshape(2, -1)
        least = both.min(axis=0)  # a pair shares what both reach
        size = len(least)
        every.append(np.partition(least, max(0, size - rank - 1))[max(0, size - rank - 1) :])
    every = np.sort(np.concatenate(every))[::-1]
    return float(every[min(len(every) - 1, rank)])


def directions(x: np.ndarray, words: list[np.ndarray], alpha: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """list_decode(), with alpha lowered step by step for rows that reach fewer than `least` directions."""
    row, code = list_decode(x, words, alpha)
    few = np.flatnonzero(np.bincount(row, minlength=len(x)) < min(least, np.prod([len(w) for w in words])))
    if not len(few):
        return row, code
    more, codes = directions(x[few], words, alpha - max(0.05, 0.1 * abs(alpha)), least)
    stay = ~np.isin(row, few)
    row, code = np.concatenate([row[stay], few[more]]), np.concatenate([code[stay], codes])
    order = np.argsort(row, kind="stable")
    return row[order], code[order]


def _near_pairs(x: np.ndarray, starts: np.ndarray, side: np.ndarray, across: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j), i < j, within the small groups that begin at starts, all groups at once, by distance in the table."""
    size = np.diff(starts)
    end = np.repeat(np.where(size <= PLAIN, starts[1:], 0), size)
    for d in range(1, int(size[size <= PLAIN].max(initial=1))):
        i = np.flatnonzero(np.arange(len(x)) + d < end)
        if not len(i):
            break
        for k in range(0, len(i), 1 << 14):
            p = i[k : k + (1 << 14)]
            p = p[~across[p] | (side[p] != side[p + d])]
            p = p[np.einsum("ij,ij->i", x[p], x[p + d]) >= threshold]
            if len(p):
                yield p, p + d


def _linked(x: np.ndarray, copies: np.ndarray, before: np.ndarray, side: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one large group: links counted here for the first time, and each row's first linked row (of its component here)."""
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    if across:
        link &= side[:, None] != side[None, :]
    n, root = np.zeros(len(x), np.int64), np.arange(len(x))
    some = np.flatnonzero(link.any(axis=1))
    if not len(some):
        return n, root
    link, own = link[np.ix_(some, some)], before[some]
    codes, at, times = np.unique(own, return_inverse=True, return_counts=True)
    use = (codes >= 0) & (times > 1)  # what one row alone has is shared by none
    column = np.where(use, np.cumsum(use) - 1, -1)[at].reshape(own.shape)
    seen = np.zeros((len(some), int(use.sum()) + 1), np.float32)
    seen[np.repeat(np.arange(len(some)), own.shape[1]), column.ravel()] = 1
    seen = seen[:, :-1]
    n[some] = (link & ~(seen @ seen.T > 0)) @ copies[some]
    first = np.full(len(some), -1)
    for i in range(len(some)):
        if first[i] < 0:
            reach = link[i].copy()
            reach[i] = True
            fresh = reach.copy()
            while fresh.any():
                step = link[fresh].any(axis=0) & ~reach
                reach |= step
                fresh = step
            first[reach] = i
    root[some] = some[first]
    return n, root


def _meet_before(before: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j share one of their codes in before (-1: none), that is, met in an earlier direction."""
    out, step = np.zeros(len(i), bool), max(1, (1 << 21) // before.shape[1] ** 2)
    for k in range(0, len(i), step):
        p, q = before[i[k : k + step]], before[j[k : k + step]]
        out[k : k + step] = ((p[:, :, None] == q[:, None, :]) & (p >= 0)[:, :, None]).any(axis=(1, 2))
    return out


def link_embeddings(
    vectors: DataFrame, threshold: float = 0.93, shared: float = 9, least: int = 10, bucket: int = 32, blocks: int = 2, seed: int = 11, cap: int = 1024
) -> DataFrame:
    """Links, components and survivors among vectors(vec_id, embedding, label); other columns are ignored.

    threshold: least cosine of a link. shared: directions that a pair at the threshold has in common on average, which sets
    alpha; a vector that reaches fewer than `least` lowers its alpha. bucket: vectors aimed at in a direction of the most frequent label, which
    sets the number of code words. cap: rows compared at once. With the defaults a pair at the threshold is missed with a probability under
    0.001; closer pairs are found more surely. Components are compared as they are given, single or double; all sums are double.

    Vectors that are equal in every component are compared as one and counted as many. Rows without an
    id, a label or a usable vector (null, empty, zero, or with a null or non-finite component) link with
    nothing: n_links 0, component_id = vec_id, kept. Only vectors of equal label and dimension link.
    Rows that repeat a vec_id are one node with the links of all their vectors, counted by rows; a row of that id without a usable vector has none. One row comes back for each input row.
    Empty tables give empty results.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    width = "<f4" if kind == "float" else "<f8"
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & some, F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("vkey", F.xxhash64("label", "embedding"))
    reps = cut(
        rows.filter("usable").groupBy("label", "vkey", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "reps"
    )
    n = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    codes = 32  # a vector reaches about four times as many directions as near pairs share
    while n * 4 * shared > bucket * codes**blocks and codes < 50_000:
        codes = codes * 5 // 4

    def decoded(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            vecs = batch.column("embedding")
            sizes = np.diff(np.asarray(vecs.offsets))
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                words = code_words(int(dim), blocks, codes, seed)
                alpha = cap_bound(int(dim), blocks, codes, seed, shared, threshold)
                own = np.flatnonzero(sizes == dim)
                at = np.asarray(vecs.offsets)[own] - np.asarray(vecs.offsets)[0]
                for part in np.array_split(np.arange(len(own)), -(-len(own) // 1024)):
                    x = flat[at[part][:, None] + np.arange(dim)].astype(np.float64)
                    u = x / np.linalg.norm(x, axis=1, keepdims=True)
                    i, code = directions(u, words, alpha, least)
                    if not len(i):
                        continue
                    ends = np.cumsum(np.bincount(i, minlength=len(part)))
                    lists = [np.sort(code[a:b]).astype("<u4").tobytes() for a, b in zip([0, *ends], ends, strict=False)]
                    raw = [r.astype(width).tobytes() for r in x]
                    bucket = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ keys[own[part]][i].view(np.uint64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": bucket.view(np.int64), "code": code.astype(np.int64), "rep": rep[own[part]][i], "copies": copies[own[part]][i],
                            "vec": pa.array([raw[k] for k in i], pa.binary()), "codes": pa.array([lists[k] for k in i], pa.binary()),
                        }
                    )

    space = F.xxhash64("label", F.size("embedding"))
    entries = reps.select(space.alias("key"), "rep", "copies", "embedding").mapInArrow(
        decoded, "bucket long, code long, rep long, copies long, vec binary, codes binary"
    )

    def verified(t: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        """Links counted where a pair first meets, and links enough to join each group's linked rows; of groups of one dimension at a time."""
        vecs, codes_of = t.column("vec").combine_chunks(), t.column("codes").combine_chunks()
        size = np.diff(np.frombuffer(vecs.buffers()[1], np.int32)[vecs.offset : vecs.offset + len(vecs) + 1])
        rep, copies, side, code = (t.column(c).to_numpy() for c in ("rep", "copies", "side", "code"))
        across = t.column("bi").to_numpy() != t.column("bj").to_numpy()
        first = starts[:-1]
        for dim in np.unique(size[first]):
            some = size == dim
            at = np.flatnonzero(some)
            begin = np.concatenate([np.searchsorted(at, first[size[first] == dim]), [len(at)]])
            x = np.frombuffer(b"".join(vecs.take(pa.array(at)).to_pylist()), width).reshape(len(at), -1).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            lists = [np.frombuffer(c, "<u4") for c in codes_of.take(pa.array(at)).to_pylist()]
            long_ = np.array([np.searchsorted(c, own) for c, own in zip(lists, code[at], strict=True)])
            before = np.full((len(at), max(1, long_.max(initial=0))), -1, np.int64)  # of sorted codes those before the group's own
            before[np.arange(before.shape[1]) < long_[:, None]] = np.concatenate([c[:k] for c, k in zip(lists, long_, strict=True)])
            n, labels = np.zeros(len(at), np.int64), np.arange(len(at))
            for i, j in _near_pairs(x, begin, side[at], across[at], threshold):
                fresh = ~_meet_before(before, i, j)
                np.add.at(n, i[fresh], copies[at[j[fresh]]])
                np.add.at(n, j[fresh], copies[at[i[fresh]]])
                labels = merge_labels(labels, i, j)
            for g in np.flatnonzero(np.diff(begin) > PLAIN):
                own = slice(begin[g], begin[g + 1])
                n[own], root = _linked(x[own], copies[at[own]], before[own], side[at[own]], bool(across[at[begin[g]]]), threshold)
                labels[own] = root + begin[g]
            hit = (n > 0) | (labels != np.arange(len(at)))
            if hit.any():
                yield pa.table({"rep": rep[at[hit]], "n": n[hit], "root": rep[at[labels[hit]]]})

    dealt = block_pairs(entries, "bucket", "rep", cap)
    found = cut(map_sorted(dealt, ["bucket", "code", "bi", "bj"], verified, "rep long, n long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("others"))
    often = rows.filter("usable").groupBy("vec_id").agg(F.min("vkey").alias("low"), F.max("vkey").alias("high")).filter("low <> high").select("vec_id")
    often = rows.filter("usable").join(often, "vec_id").select("vec_id", "label", "vkey", "embedding").distinct()  # of ids that stand in several classes
    often = cut(often.join(reps, ["label", "vkey", "embedding"]).select("vec_id", "label", "vkey", "embedding", "rep", "copies"), "often")
    first = often.groupBy("vec_id").agg(F.min("rep").alias("b"))
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    parts = connected_components(edges.unionByName(often.join(first, "vec_id").select(F.col("rep").alias("a"), "b")))
    by_rep = often.groupBy("vec_id", "rep").agg(F.sum(F.col("copies") - 1).alias("same")).join(counts, "rep", "left")  # classes of one rep have one count
    more = by_rep.groupBy("vec_id").agg(F.sum(F.coalesce("others", F.lit(0)) + F.col("same")).alias("links_of_all"))
    classes = reps.join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select(
        "label", "vkey", "embedding",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
        F.lit(True).alias("usable"),
    )
    out = rows.join(classes, ["label", "vkey", "embedding", "usable"], "left").join(more, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.when(F.col("n_links").isNotNull(), F.coalesce("links_of_all", "n_links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
