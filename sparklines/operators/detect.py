"""Which format a source has: every format scored over its first lines in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklines.formats import formats, parse
from sparklines.model import PARTS

SAMPLE = 200


def score_formats(lines: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """(src, format, ordinal, score) of lines(src, line_idx, raw): mean weight of the sample's lines, 0 for unparsed ones."""
    head = lines.filter(F.col("line_idx") < sample) if sample else lines
    scored = []
    for f in formats():
        parts = parse(F.col("raw"), f.name)
        scored.append(F.when(parts.isNotNull(), f.weight(parts)).otherwise(0.0))
    head = head.select("src", F.array(*scored).alias("w"))
    means = head.groupBy("src").agg(F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(len(scored))]).alias("s"))
    names = F.array(*[F.lit(f.name) for f in formats()])
    return means.select("src", F.posexplode("s").alias("ordinal", "score")).select("src", F.get(names, F.col("ordinal")).alias("format"), "ordinal", "score")


def detect_formats(lines: DataFrame, sample: int | None = SAMPLE) -> DataFrame:
    """(src, format): the highest score above 0, of equal ones the last in order; `plain` if none."""
    best = score_formats(lines, sample).groupBy("src").agg(F.max_by("format", F.struct("score", "ordinal")).alias("format"), F.max("score").alias("score"))
    return best.select("src", F.when(F.col("score") > 0, F.col("format")).otherwise("plain").alias("format"))


def with_parts(lines: DataFrame, format: str | DataFrame) -> DataFrame:
    """Lines with their parts, all of one format or by the (src, format) table that detect_formats() gives."""
    raw = F.col("raw")
    if isinstance(format, str):
        return lines.withColumn("parts", parse(raw, format))
    joined = lines.join(format, "src", "left")
    parts = F.lit(None).cast(PARTS)
    for f in formats():
        parts = F.when(F.col("format") == f.name, parse(raw, f.name)).otherwise(parts)
    return joined.withColumn("parts", parts)
