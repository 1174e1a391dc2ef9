"""Connected components as Spark joins: contraction of the graph round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklines.llm.common import cut, drop


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in edges(a, b); component_id is the smallest id reachable.

    Each round maps a node to the neighbour (or itself) that is least in that round's order and merges
    the nodes that map alike. The first round's order is the id itself, which settles stars around
    their smallest node; later ones hash the ids anew, so that the expected number of nodes falls by a
    constant factor whatever the shape (a path, say). Minima are aggregated before the shuffle and hot
    nodes meet only in joins that AQE splits. Edges with a null end or between equal ids say nothing.
    No edges: no rows.
    """
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = cut(edges.filter("a <> b").select(*pair).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        k = len(maps)
        order = (lambda c: F.struct(c)) if k == 0 else (lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c), c))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("m"))
        rep = F.when(order(F.col("m")) < order(F.col("a")), F.col("m")).otherwise(F.col("a"))
        maps.append(cut(least.select(F.col("a").alias("id"), rep.alias("rep")), "map"))
        ra = maps[-1].select(F.col("id").alias("a"), F.col("rep").alias("ra"))
        rb = maps[-1].select(F.col("id").alias("b"), F.col("rep").alias("rb"))
        merged = left.join(ra, "a").join(rb, "b").filter("ra <> rb")
        merged = cut(merged.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        drop(left)
        left = merged
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    found = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("id").alias("rep"), F.col("rep").alias("_r"))
        found = found.join(later, "rep", "left").select("id", F.coalesce("_r", "rep").alias("rep"))
    if len(maps) == 1:
        return found.select("id", F.col("rep").alias("component_id"))
    found = cut(found, "roots")
    lowest = found.groupBy("rep").agg(F.min("id").alias("component_id"))
    return found.join(lowest, "rep").select("id", "component_id")
