"""Lines of log files: lines(src, line_idx, raw), numbered from 0 within each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Terminal control sequences: CSI, OSC (to BEL or ESC \), other two-byte escapes; and carriage returns.
CONTROL = "\u001b\\[[^@-~]*[@-~]?|\u001b\\][^\u0007]*?(?:\u0007|\u001b\\\\|$)|\u001b.?|\r"

#: Most blocks of files whose offsets are sent to every task, of about 60 bytes each: 256 TB in blocks of 128 MB.
BROADCAST_SPLITS = 1 << 21


def strip_control(raw: Column) -> Column:
    """A line without control sequences."""
    return F.when(F.contains(raw, F.lit("\u001b")) | F.contains(raw, F.lit("\r")), F.regexp_replace(raw, CONTROL, "")).otherwise(raw)


def read_lines(spark: SparkSession, path: str | list[str], clean: bool = False, number: bool = True, by_name: bool = False) -> DataFrame:
    """Lines of files or flat directories; only a line feed ends a line and carriage returns are dropped anywhere.

    clean: also strip terminal control sequences. number: give line_idx. by_name: src is the file's name.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    src = F.col("_metadata.file_name") if by_name else F.col("_metadata.file_path")
    lines = text.select(
        src.alias("src"), F.col("_metadata.file_block_start").alias("blk"), F.monotonically_increasing_id().alias("mid"),
        (strip_control(F.col("value")) if clean else F.replace("value", F.lit("\r"), F.lit(""))).alias("raw"),
    )
    return number_lines(lines, len(text._jdf.inputFiles()) + 2 * text.rdd.getNumPartitions()) if number else lines.select("src", "raw")


def number_lines(lines: DataFrame, splits: int | None = None) -> DataFrame:
    """line_idx from (src, blk, mid): ids count up within a block, and the blocks before it add their sizes.

    Two passes over the same splits. The blocks' sizes are a row each, found by the hash of their file and their place. splits: a bound of the blocks' number;
    up to BROADCAST_SPLITS of them every task gets the offsets and no line is moved or sorted, otherwise Spark picks the join.
    """
    lines = lines.withColumn("_file", F.xxhash64("src"))
    sizes = lines.groupBy("_file", "blk").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("m0"), F.min("src").alias("low"), F.max("src").alias("high"))
    before = W.partitionBy("_file").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    off = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("m0")
    off = F.when(F.col("low") == F.col("high"), off).otherwise(F.raise_error(F.lit("two files have names of one hash")))
    offsets = sizes.select("_file", "blk", off.alias("off"))
    if splits is not None and splits <= BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    return lines.join(offsets, ["_file", "blk"]).select("src", (F.col("mid") + F.col("off")).alias("line_idx"), "raw")


def _budget(lines: DataFrame, size: int, last: bool, bucket: int = 4096) -> DataFrame:
    """Lines of a source whose sizes add up to no more than size from one end on; sums go over buckets of lines, then within the buckets that are near enough."""
    end = F.desc if last else F.asc
    lines = lines.withColumns({"_bucket": F.floor(F.col("line_idx") / bucket), "_size": F.octet_length("raw") + 1})
    sums = lines.groupBy("src", "_bucket").agg(F.sum("_size").alias("_all"))
    before = W.partitionBy("src").orderBy(end("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    near = sums.withColumn("_before", F.coalesce(F.sum("_all").over(before), F.lit(0))).filter(F.col("_before") < size).drop("_all")
    upto = W.partitionBy("src", "_bucket").orderBy(end("line_idx")).rowsBetween(W.unboundedPreceding, 0)
    used = F.col("_before") + F.sum("_size").over(upto)
    return lines.join(near, ["src", "_bucket"]).withColumn("_used", used).filter(F.col("_used") <= size).drop("_used", "_before", "_bucket", "_size")


def head_bytes(lines: DataFrame, size: int = 16 << 20) -> DataFrame:
    """Whole lines within the first bytes of each source; see ranges.head_of_files() for files."""
    return _budget(lines.filter(F.col("line_idx") < size), size, False)


def tail_bytes(lines: DataFrame, size: int = 16 << 20) -> DataFrame:
    """Whole lines within the last bytes of each source; see ranges.tail_of_files() for files."""
    return _budget(lines, size, True)


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    return lines.filter(F.col("line_idx") < n)


def tail_lines(lines: DataFrame, n: int) -> DataFrame:
    """The last n lines of each source; each task keeps its own last ones before they move."""
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("line_idx")))
    return lines.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")


def fingerprints(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src, fingerprint) of files from their size and time of change: a new value means what was saved no longer fits."""
    state = F.xxhash64("_metadata.file_size", "_metadata.file_modification_time")
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("src"), state.alias("fingerprint"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Raw lines as text files in order of (src, line_idx)."""
    lines.orderBy("src", "line_idx").select("raw").write.text(path)
