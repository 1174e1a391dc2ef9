"""Overlapping spans cut into pieces, each with the tags of the spans of highest priority over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklines.model import let

SPAN = ("s", "e", "priority", "a", "b")


def line_segments(spans: Column) -> Column:
    """array<struct<s, e, a, b>> of a line's array<struct<s, e, priority, a, b>>, in order; see segment_spans()."""

    def best(all_: Column, p: Column, tag: str) -> Column:
        over = F.filter(all_, lambda x: (x["s"] <= p["s"]) & (p["e"] <= x["e"]) & x[tag].isNotNull())
        return F.array_max(F.transform(over, lambda x: F.struct(x["priority"].alias("p"), (-x["s"]).alias("f"), x[tag].alias("tag"))))["tag"]

    def pieces(all_: Column) -> Column:
        cuts = F.array_sort(F.array_distinct(F.flatten(F.transform(all_, lambda x: F.array(x["s"], x["e"])))))
        near = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
        cut = let(cuts, lambda c: F.when(F.size(c) > 1, near(c)))
        styled = F.transform(cut, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), best(all_, p, "a").alias("a"), best(all_, p, "b").alias("b")))
        return F.filter(styled, lambda x: x["a"].isNotNull() | x["b"].isNotNull())

    def joined(styled: Column) -> Column:
        goes_on = lambda x, i: (x["s"] == y(i)["e"]) & x["a"].eqNullSafe(y(i)["a"]) & x["b"].eqNullSafe(y(i)["b"])
        y = lambda i: F.get(styled, i - 1)
        first = F.filter(F.transform(styled, lambda x, i: F.when((i == 0) | ~F.coalesce(goes_on(x, i), F.lit(False)), i)), lambda i: i.isNotNull())
        after = lambda f, k: F.coalesce(F.get(f, k + 1), F.size(styled))
        run = lambda i, last: F.struct(F.get(styled, i)["s"].alias("s"), F.get(styled, last)["e"].alias("e"), F.get(styled, i)["a"].alias("a"), F.get(styled, i)["b"].alias("b"))
        return let(first, lambda f: F.transform(f, lambda i, k: run(i, after(f, k) - 1)))

    return let(let(F.filter(spans, lambda x: x["s"] < x["e"]), pieces), joined)


def segment_spans(spans: DataFrame) -> DataFrame:
    """(src, line_idx, s, e, a, b) from spans(src, line_idx, s, e, priority, a, b).

    The line is cut at every start and end. In a piece, a and b each come from the span of highest priority that
    has it (of equals, the one that starts first); pieces without either are left out, and equal
    neighbours are joined. Spans move once, to their line.
    """
    lines = spans.filter("s < e").groupBy("src", "line_idx").agg(F.collect_list(F.struct(*SPAN)).alias("_spans"))
    return lines.select("src", "line_idx", F.explode(F.array(line_segments(F.col("_spans")))).alias("_x")).select("src", "line_idx", F.inline("_x"))
