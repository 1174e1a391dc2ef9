"""Searching the shown lines, and moving about in them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklines.functions.levels import normalize_level, scan_level
from sparklines.functions.spans import SPANS, find_spans, java_pattern, quote
from sparklines.operators.visibility import is_regex

#: Lines of a source that one running sum takes; larger sources are summed in buckets of so many.
BUCKET = 1 << 20


def pattern_of(query: str, case: bool = True) -> str:
    """A query as a pattern: literal unless it has a special character; case False ignores case."""
    return java_pattern(("" if case else "(?i)") + (query if is_regex(query) else quote(query)))


def search(lines: DataFrame, query: str, text: Column | str = "raw", case: bool = True, unit: str = "bytes") -> DataFrame:
    """lines(src, line_idx) with matches, array<struct<s, e>> in the text, where there are any."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = pattern_of(query, case)
    # a generated row holds the text as a value; the filter and the spans would each compute it anew
    hit = lines.select("src", "line_idx", F.explode(F.array(text)).alias("_text")).filter(F.rlike("_text", F.lit(pattern)))
    return hit.select("src", "line_idx", F.explode(F.array(find_spans(F.col("_text"), pattern, unit))).alias("matches"))


def _of_filter(filter_id: int, x: Column) -> Column:
    return F.struct(F.lit(filter_id).alias("filter_id"), x["s"].alias("s"), x["e"].alias("e"))


def match_spans(lines: DataFrame, filters, match_only: bool = True) -> DataFrame:
    """(src, line_idx, filter_id, s, e): every match of each including filter, or the whole line; excludes give none."""
    raw, none, found = F.col("raw"), F.array().cast(SPANS), []
    for f in filters:
        if f.enabled and f.include:
            pattern = pattern_of(f.pattern)
            spans = find_spans(raw, pattern) if match_only else F.array(F.struct(F.lit(0).alias("s"), F.octet_length(raw).alias("e")))
            spans = F.when(F.rlike(raw, F.lit(pattern)), spans).otherwise(none)
            found.append(F.transform(spans, partial(_of_filter, f.id)))
    every = F.concat(*found) if found else F.array().cast("array<struct<filter_id:int,s:int,e:int>>")
    return lines.select("src", "line_idx", F.inline(every))


def total_matches(found: DataFrame) -> DataFrame:
    """(lines, matches) of a search."""
    return found.agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.size("matches")), F.lit(0)).cast("long").alias("matches"))


def occurrences(found: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(src, line_idx, s, e, occurrence): matches numbered from 1 within each source.

    Running sums over buckets of lines, then of the buckets' totals: no window holds more than a bucket.
    """
    n = F.size("matches").cast("long")
    rows = found.withColumn("_b", F.floor(F.col("line_idx") / bucket))
    within = W.partitionBy("src", "_b").orderBy("line_idx").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("src").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("src", "_b").agg(F.sum(n).alias("_n"))
    totals = totals.select("src", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_in", F.coalesce(F.sum(n).over(within), F.lit(0))).join(totals, ["src", "_b"])
    rows = rows.select("src", "line_idx", (F.col("_in") + F.col("_before")).alias("_at"), F.posexplode("matches").alias("_k", "m"))
    return rows.select("src", "line_idx", "m.s", "m.e", (F.col("_at") + F.col("_k") + 1).alias("occurrence"))


def next_match(found: DataFrame, line: int, start: int = -1, back: bool = False) -> DataFrame:
    """For each source the match after (line, start), or before it if back; past the last it wraps to the first.

    A start of -1 takes the line itself in, going forward.
    """
    spots = found.select("src", "line_idx", F.inline("matches"))
    at = F.struct(F.col("line_idx"), F.col("s"))
    here = F.struct(F.lit(line).cast("long"), F.lit(start))
    pick, beyond = (F.max, at < here) if back else (F.min, at > here)
    spot = F.struct("line_idx", "s", "e")
    got = spots.groupBy("src").agg(F.coalesce(pick(F.when(beyond, spot)), pick(spot)).alias("m"))
    return got.select("src", "m.line_idx", "m.s", "m.e")


def line_level(raw: Column, parts: Column | None = None) -> Column:
    """Level from the parts, else from a keyword in the line."""
    scanned = scan_level(raw)
    return scanned if parts is None else F.coalesce(F.when(parts["level"].isNotNull(), F.coalesce(normalize_level(parts["level"]), F.lit("UNKNOWN"))), scanned)


def next_level(lines: DataFrame, level: Column, wanted: tuple[str, ...] = ("ERROR", "FATAL"), bucket: int = BUCKET) -> DataFrame:
    """(src, line_idx, prev, next): for each line the nearest wanted lines before and after it, not itself; no wrap."""
    at = F.when(level.isin(*wanted), F.col("line_idx"))
    rows = lines.select("src", "line_idx", at.alias("_at"), F.floor(F.col("line_idx") / bucket).alias("_b"))
    within = W.partitionBy("src", "_b").orderBy("line_idx")
    up, down = within.rowsBetween(W.unboundedPreceding, -1), within.rowsBetween(1, W.unboundedFollowing)
    edges = rows.groupBy("src", "_b").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    over = W.partitionBy("src").orderBy("_b")
    edges = edges.select(
        "src", "_b", F.max("hi").over(over.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.min("lo").over(over.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    near = rows.withColumns({"p": F.max("_at").over(up), "n": F.min("_at").over(down)}).join(edges, ["src", "_b"])
    return near.select("src", "line_idx", F.coalesce("p", "_before").alias("prev"), F.coalesce("n", "_after").alias("next"))


def goto_line(lines: DataFrame, number: int) -> DataFrame:
    """For each source the shown line nearest to a 1-based number, the earlier of two; 0 is refused."""
    if number < 1:
        raise ValueError("lines are numbered from 1")
    far = F.abs(F.col("line_idx") - (number - 1))
    return lines.groupBy("src").agg(F.min_by("line_idx", F.struct(far, F.col("line_idx"))).alias("line_idx"))
