"""Nearest neighbours by collision counting over single-projection sorted arrays.

Largest inner products become least distances: vectors are scaled by the largest norm and get one more coordinate that lifts them to norm 1,
queries are scaled to norm 1. Each vector is projected on many random directions, and each direction's projections are kept sorted. A query
opens a window round its own projection in every array and collides with the vectors in it; a vector with enough collisions is verified
by its exact inner product. Windows grow with the search radius (virtual rehashing: wider windows over the same arrays take the place of hash
tables of each radius), until as many vectors as are asked for are verified within the radius. How many collisions are enough follows from the
distribution of a vector at just that radius, so a true neighbour is missed with a fixed small probability whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklines.llm.common import cut, map_groups

#: Half a window's width as a multiple of the radius, and the factor by which the radius grows.
WIDTH, GROWTH = 2.0, 1.04
#: Rows that the first radius is guessed from, and queries whose windows are counted together.
SAMPLE, BATCH = 512, 32


@lru_cache(maxsize=8)
def misses_allowed(projections: int, miss: float) -> int:
    """The most windows that a vector at the radius is outside of, but for a probability of `miss`."""
    out, total = 1 - erf(WIDTH / sqrt(2)), 0.0
    for k in range(projections + 1):
        total += comb(projections, k) * out**k * (1 - out) ** (projections - k)
        if total >= 1 - miss:
            return k
    return projections


class SortedArrays:
    """The projections of lifted vectors on each direction: their sorted values, and each vector's place among them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, scale: float, largest: float, projections: int, seed: int):
        """x: (vectors, dim), 65,535 at most; ids, rows: their ids and the numbers of their rows; scale, largest: what lengths are divided by, and the largest norm after that."""
        self.x, self.ids, self.rows, self.scale, self.largest = x, ids, rows, scale, largest
        u = x / scale / largest
        rest = np.sqrt(np.maximum(0, 1 - (u * u).sum(axis=1, keepdims=True)))
        self.lines = np.random.default_rng([seed, x.shape[1]]).standard_normal((projections, x.shape[1] + 1))
        at = self.lines @ np.concatenate([u, rest], axis=1).T
        order = np.argsort(at, axis=1)
        self.values = np.take_along_axis(at, order, axis=1)
        self.places = np.empty(at.shape, np.uint16)
        np.put_along_axis(self.places, order, np.arange(len(x), dtype=np.uint16)[None], axis=1)

    def outside(self, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, vectors): in how many of the arrays a vector lies outside the window of a query."""
        out = np.zeros((len(centres), len(self.x)), np.uint16)
        for values, place, centre in zip(self.values, self.places, centres.T, strict=True):
            low = np.searchsorted(values, centre - WIDTH * radius).astype(np.uint16)
            high = np.searchsorted(values, centre + WIDTH * radius).astype(np.uint16)
            out += (place[None] - low[:, None]) >= (high - low)[:, None]  # unsigned: places before low are large
        return out

    def search(self, queries: np.ndarray, rows: np.ndarray, k: int, miss: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places, inner products) for each query: k vectors or more (all, if there are fewer), those with the largest inner products among them, not its own row."""
        n, allowed = len(self.x), misses_allowed(len(self.lines), miss)
        unit = queries / self.scale
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        length = np.linalg.norm(queries / self.scale, axis=1) * self.largest * self.scale * self.scale
        centres = unit @ self.lines[:, :-1].T
        apart = lambda score, i: np.sqrt(np.maximum(0, 2 - 2 * score / length[i]))  # noqa: E731  of a lifted vector and a query
        few = min(n, SAMPLE)
        guess = np.sort(np.sqrt(np.maximum(0, 2 - 2 * (queries @ self.x[:few].T) / length[:, None])), axis=1)
        radius = np.nan_to_num(np.maximum(0.05, guess[:, min(few - 1, -(-k * few // n) + 1)]), nan=2.0)  # within it a few rows promise k of all, and some
        left, checked = np.arange(len(queries)), np.zeros((len(queries), n), bool)
        own = rows[:, None] == self.rows[None]
        best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        while len(left):
            near = (self.outside(centres[left], radius[left]) <= allowed) | (radius[left] >= 2)[:, None]
            go_on = []
            for i, hit in zip(left.tolist(), near, strict=True):
                some = np.flatnonzero(hit & ~checked[i] & ~own[i])
                checked[i, some] = True
                best[i].append((some, self.x[some] @ queries[i]))
                at, score = (np.concatenate(c) for c in zip(*best[i], strict=True))
                if radius[i] >= 2 or (apart(score, i) <= radius[i]).sum() >= k:
                    yield i, at, score
                else:
                    go_on.append(i)
            left = np.array(go_on, np.int64)
            radius[left] *= GROWTH

    def best(self, query: np.ndarray, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these places, and their inner products summed alike for equal vectors."""
        if len(at) > k:
            bound = np.partition(score, len(score) - k)[len(score) - k]
            at = at[score >= bound - 1e-9 * (abs(bound) + np.abs(score).max())]
        score = (self.x[at] * query).sum(axis=1)
        order = np.lexsort((self.rows[at], self.ids[at], -score))[:k]
        return at[order], score[order]


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, projections: int = 96, miss: float = 0.1, shard: int = 16384, together: int = 512, seed: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner product of each row of vectors(vec_id, embedding) whose id `every` divides.

    Every other row is a candidate. Rows are dealt over shards of about `shard` vectors, each with sorted arrays of its own; blocks of about
    `together` queries meet every shard, and the best k of each shard are merged. miss: probability with which a true neighbour's collisions are too few.
    Scores are sums of products in double precision; equal ones rank by the smaller vec_id.

    Rows without an id or with an unusable vector (null, empty, zero, or with a null or non-finite component) take no part. Rows that repeat an id are
    rows of their own, as queries and as candidates. Vectors of different dimension never meet. Fewer than k candidates are all returned. Empty tables
    and tables without queries give no rows. Other columns are ignored.
    """
    if shard > 1 << 15:
        raise ValueError("shard may be 32768 at most")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(~bad & some, F.lit(False)))
    rows = cut(rows.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    scale = rows.agg(F.max(F.array_max(F.transform("embedding", F.abs)))).first()[0] or 1.0
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v / scale) * (v / scale), lambda a: F.sqrt(a))
    asked = F.col("vec_id") % every == 0
    sizes = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"), F.ceil(F.count_if(asked) / together).cast("int").alias("blocks"), F.max(norm).alias("largest")
    )
    known = rows.join(sizes.filter("blocks > 0"), "dim")
    dealt = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["dim", "part", "block", "asked", "row", "vec_id", "embedding", "largest"]
    data = known.withColumn("part", dealt(1, "shards")).withColumn("block", each("blocks")).withColumn("asked", F.lit(False))
    queries = known.filter(asked).withColumn("block", dealt(2, "blocks")).withColumn("part", each("shards")).withColumn("asked", F.lit(True))

    def found(t: pa.Table) -> pa.Table | None:
        x = np.asarray(t.column("embedding").combine_chunks().flatten()).reshape(t.num_rows, -1)
        ids, row, is_query = (t.column(c).to_numpy() for c in ("vec_id", "row", "asked"))
        own, ask = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        if not len(own) or not len(ask):
            return None
        arrays = SortedArrays(x[own], ids[own], row[own], scale, t.column("largest")[0].as_py() * (1 + 1e-12), projections, seed)
        got: list[tuple[np.ndarray, ...]] = []
        for some in np.array_split(ask, -(-len(ask) // BATCH)):
            for i, at, score in arrays.search(x[some], row[some], k, miss):
                at, score = arrays.best(x[some[i]], at, score, k)
                got.append((np.full(len(at), row[some[i]]), np.full(len(at), ids[some[i]]), arrays.ids[at], arrays.rows[at], score))
        query, query_id, vec_id, vec_row, score = (np.concatenate(c) for c in zip(*got, strict=True))
        return pa.table({"query": query, "query_id": query_id, "vec_id": vec_id, "row": vec_row, "score": score})

    met = data.select(*cols).unionByName(queries.select(*cols))
    best = map_groups(met, ["dim", "part", "block"], found, "query long, query_id long, vec_id long, row long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
