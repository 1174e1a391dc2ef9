"""Mixing sources to target weights: repetition rates from aggregated sizes, one seeded draw for the fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklines.llm.common import cut, small, unit_draw

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row for each source, null included.

    Sources in order of their UTF-8 bytes (that is, by code point), null last, weigh weights[0],
    weights[1], ... and again from the start. Together they get share x all sizes, dealt by weight;
    none gets over most x its own size, and what that cuts off is dealt again by weight. The fixed
    point has a closed form: with the sources in order of cap / weight, the first ones stop at their
    caps and the others share the rest by weight. Sums of integers only, so the result is exact up to
    one division. The table has one row for each source, whatever the number of documents.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("w"), F.col("source").isNull(), "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_w": F.sum("w").over(after),
        }
    )
    s = s.withColumn("full", F.col("cap") * F.col("left_w") <= F.col("left") * F.col("w"))
    open_ = W.partitionBy()
    rest = F.min(F.when(~F.col("full"), F.struct(-F.col("left_w"), F.col("left")))).over(open_)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * rest["left"] / -rest["col1"])
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", columns: list[str] | None = None
) -> DataFrame:
    """How often each of docs(doc_id, text, source) goes into the mix: doc_id, size, source_size, target, copies, taken.

    A source's rate is target / source_size. A document is taken floor(rate) times, and once more if a
    draw seeded by its id falls under the fraction; reruns draw alike, and so do rows that repeat an id. columns: further columns of docs to keep (they must not clash with the six). Null text:
    size 0. Null source: a source of its own. Null ids share a draw. A source without words has target 0
    and its documents go once. Sizes are summed before the shuffle; the per-source table joins back.
    """
    keep = columns or []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    sized = sized if keep else cut(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, weights, share, most).withColumnRenamed("source", "_source"), "targets")
    targets = small(targets, targets.count())
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["_source"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    extra = (unit_draw(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    copies = F.floor(rate) + extra
    out = joined.withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
