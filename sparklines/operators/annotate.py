"""Marks and comments on lines, and the report made of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def commented(comments: DataFrame) -> DataFrame:
    """(src, line_idx) of lines in any comment of comments(comment_id, src, text, line_indices)."""
    return comments.select("src", F.explode("line_indices").alias("line_idx")).distinct()


def marked_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """The lines that are marked; marks(src, line_idx) without a line say nothing."""
    return lines.join(marks, ["src", "line_idx"], "left_semi")


def standalone_marks(marks: DataFrame, comments: DataFrame) -> DataFrame:
    """Marks outside every comment."""
    return marks.join(commented(comments), ["src", "line_idx"], "left_anti").distinct()


def in_runs(spots: DataFrame, bucket: int = 4096) -> DataFrame:
    """(src, line_idx, run): the distinct spots, each with the first line_idx of its run of adjacent ones.

    Two levels: runs within buckets of lines, then those that touch a bucket's end are joined over the ends; a window holds a
    bucket's spots, or two runs for each bucket of a source.
    """
    b = F.floor(F.col("line_idx") / bucket)
    island = F.col("line_idx") - F.row_number().over(W.partitionBy("src", "_b").orderBy("line_idx"))
    spots = spots.select("src", "line_idx").distinct().withColumn("_b", b).withColumn("_g", island)
    parts = spots.groupBy("src", "_b", "_g").agg(F.min("line_idx").alias("first"), F.max("line_idx").alias("last"))
    touches = (F.col("first") == F.col("_b") * bucket) | (F.col("last") == F.col("_b") * bucket + bucket - 1)
    order = W.partitionBy("src").orderBy("first")
    new = F.when(F.col("first") == F.lag("last").over(order) + 1, F.lit(None)).otherwise(F.col("first"))
    over = parts.filter(touches).withColumn("_new", new).withColumn("run", F.last("_new", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    every = over.select("src", "_b", "_g", "run").unionByName(parts.filter(~touches).select("src", "_b", "_g", F.col("first").alias("run")))
    return spots.join(every, ["src", "_b", "_g"]).select("src", "line_idx", "run")


def runs(spots: DataFrame, bucket: int = 4096) -> DataFrame:
    """(src, first, last, n): runs of adjacent line_idx."""
    return in_runs(spots, bucket).groupBy("src", "run").agg(F.max("line_idx").alias("last"), F.count(F.lit(1)).alias("n")).select("src", F.col("run").alias("first"), "last", "n")


def entry_lines(lines: DataFrame, marks: DataFrame, comments: DataFrame) -> DataFrame:
    """(src, kind, ref, commentary, line_idx, raw): the lines of comments, and of runs of marks outside them; a comment's line that isn't there has no raw.

    kind 0: comment (ref: its id), 1: marks (ref: the run's first line), which is also the order of those that start on the same line.
    """
    of_comments = comments.select("src", F.lit(0).alias("kind"), F.col("comment_id").cast("long").alias("ref"), F.col("text").alias("commentary"), F.explode("line_indices").alias("line_idx"))
    alone = standalone_marks(marks.join(lines.select("src", "line_idx"), ["src", "line_idx"], "left_semi"), comments)
    of_marks = in_runs(alone).select("src", F.lit(1).alias("kind"), F.col("run").alias("ref"), F.lit("").alias("commentary"), "line_idx")
    return of_comments.unionByName(of_marks).join(lines.select("src", "line_idx", "raw"), ["src", "line_idx"], "left")


def _number(line_idx: Column) -> Column:
    return (line_idx + 1).cast("string")


def entries(lines: DataFrame, marks: DataFrame, comments: DataFrame) -> DataFrame:
    """(src, first, kind, ref, commentary, lines, line_numbers): comments, and runs of marks outside them, by first line; numbers are 1-based.

    An entry's lines are one string; see report_fragments() for entries of any length.
    """
    group = entry_lines(lines, marks, comments).groupBy("src", "kind", "ref", "commentary").agg(
        F.min("line_idx").alias("first"), F.array_sort(F.collect_list(F.when(F.col("raw").isNotNull(), F.struct("line_idx", "raw")))).alias("l")
    )
    return group.select(
        "src", "first", "kind", "ref", "commentary",
        F.array_join(F.transform("l", lambda x: F.concat(_number(x["line_idx"]), F.lit(": "), x["raw"])), "\n").alias("lines"),
        F.array_join(F.transform("l", lambda x: _number(x["line_idx"])), ", ").alias("line_numbers"),
    )


def report_fragments(lines: DataFrame, marks: DataFrame, comments: DataFrame, header: str, group: str, footer: str, date: Column | None = None) -> DataFrame:
    """(src, section, first, kind, ref, part, line_idx, text): the report of each source in pieces; joined in the order of the columns before text they are report()'s string.

    Lines stay rows of their own, so a source may have any number of marks and a run any length. section: 0 header, 1 entries, 2 footer. The group's
    template may hold {{commentary}} anywhere, {{lines}} and {{line_numbers}} once or more.
    """
    day = date if date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd")
    common = {"filename": F.col("src"), "date": day}
    shown = entry_lines(lines, marks, comments)
    keys = ["src", "kind", "ref", "commentary"]
    found = shown.groupBy(*keys).agg(F.min("line_idx").alias("first"), F.min(F.when(F.col("raw").isNotNull(), F.col("line_idx"))).alias("_low"))
    none = F.lit(None).cast("long")
    row = lambda section, first, kind, ref, part, line, text: [
        "src", F.lit(section).alias("section"), first.alias("first"), kind.alias("kind"), ref.alias("ref"), F.lit(part).alias("part"), line.alias("line_idx"), text.alias("text")
    ]
    own = [F.col(c) for c in ("first", "kind", "ref")]
    ends = [found.select("src").distinct().select(*row(k, none, F.lit(None).cast("int"), none, 0, none, _fill(t, **common))) for k, t in ((0, header), (2, footer))]
    out = ends[0].unionByName(ends[1])
    for part, piece in enumerate(re.split(r"(\{\{lines\}\}|\{\{line_numbers\}\})", group)):
        if piece not in ("{{lines}}", "{{line_numbers}}"):
            if piece:
                out = out.unionByName(found.select(*row(1, *own, part, none, _fill(piece, **common, commentary=F.col("commentary")))))
            continue
        number = _number(F.col("line_idx"))
        text, between = (F.concat(number, F.lit(": "), "raw"), "\n") if piece == "{{lines}}" else (number, ", ")
        each = shown.filter("raw IS NOT NULL").join(found, keys)
        text = F.concat(F.when(F.col("line_idx") > F.col("_low"), F.lit(between)).otherwise(""), text)
        out = out.unionByName(each.select(*row(1, *own, part, F.col("line_idx"), text)))
    return out


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def report(found: DataFrame, header: str, group: str, footer: str, date: Column | None = None) -> DataFrame:
    """(src, report): a filled header, a filled group for each entry in order, a filled footer.

    Placeholders: {{filename}} and {{date}} anywhere; {{commentary}}, {{lines}} and {{line_numbers}} in the group.
    """
    day = date if date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd")
    common = {"filename": F.col("src"), "date": day}
    one = _fill(group, **common, commentary=F.col("commentary"), lines=F.col("lines"), line_numbers=F.col("line_numbers"))
    body = found.select("src", F.struct("first", "kind", "ref", one.alias("t")).alias("x")).groupBy("src").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return body.select("src", F.concat(_fill(header, **common), F.array_join(F.transform("x", lambda x: x["t"]), ""), _fill(footer, **common)).alias("report"))
