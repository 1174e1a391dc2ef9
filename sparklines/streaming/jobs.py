"""The batch operators on streams: shown lines appended as they come, running counts, latest lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparklines.model import PARTS, FilterDef
from sparklines.operators.detect import detect_formats, with_parts
from sparklines.operators.visibility import filter_hits, needs_parts, visible_lines
from sparklines.shared import cut, drop
from sparklines.sources.lines import tail_lines
from sparklines.streaming.versions import Versions

#: Most ranges of a batch whose first numbers are sent to every task, a path each; beyond it Spark picks the join.
BROADCAST_RANGES = 1 << 17


def pipe_lines(stream: DataFrame, value: str = "value", src: str | None = None) -> DataFrame:
    """lines(src, raw) of a stream of records of whole lines, as message queues and sockets give them; see pipes.whole_lines() for records cut anywhere."""
    source = F.col(src) if src else F.lit("stream")
    line = F.explode(F.split(F.regexp_replace(F.col(value).cast("string"), "\n$", ""), "\n"))
    return stream.select(source.alias("src"), line.alias("_l")).select("src", F.replace("_l", F.lit("\r"), F.lit("")).alias("raw"))


def stream_visible(lines: DataFrame, filters: list[FilterDef], format: str | None = None) -> DataFrame:
    """The same decision as in batch, on a stream; stateless, so output mode append."""
    parsed = with_parts(lines, format) if format and needs_parts(filters) else lines
    return visible_lines(parsed, filters)


def write_visible(lines: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Append shown lines to parquet files, each once: a restart goes on from the checkpoint."""
    writer = lines.drop("parts").writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def running_counts(lines: DataFrame, filters: list[FilterDef]) -> DataFrame:
    """(id, pattern, n) so far of each enabled filter that counts a line; for output mode complete or update."""
    found = filter_hits(F.col("raw"), F.col("parts") if "parts" in lines.columns else F.lit(None).cast(PARTS), filters)
    hits = [F.when(hit, F.struct(F.lit(f.id).alias("id"), F.lit(f.pattern).alias("pattern"))) for f, hit in found]
    one = lines.select(F.explode(F.array_compact(F.array(*hits))).alias("f"))
    return one.groupBy("f.id", "f.pattern").agg(F.count(F.lit(1)).alias("n"))


def error_rates(lines: DataFrame, time: str, level: str, late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """(window, level, n): lines by level in tumbling windows; lines later than `late` are left out."""
    return lines.withWatermark(time, late).groupBy(F.window(time, every), level).agg(F.count(F.lit(1)).alias("n"))


def detect_as_it_comes(lines: DataFrame, table: str, checkpoint: str, once: bool = False, path: str | None = None) -> StreamingQuery:
    """Keep a view (src, format) of sources whose format is known; a source is asked again while it is `plain`.

    Each batch's lines are numbered within it, and its formats are added to those of sources without one. path: where the versions of the table lie (beside the checkpoint).
    """

    def learn(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path or checkpoint + "-formats")
        numbered = batch if "line_idx" in batch.columns else batch.withColumn("line_idx", F.lit(0).cast("long"))

        def grown(known: DataFrame | None) -> DataFrame:
            asked = numbered if known is None else numbered.join(known, "src", "left_anti")  # lines of sources of known format aren't parsed
            found = detect_formats(asked, sample=None).filter("format <> 'plain'")
            return found if known is None else known.unionByName(found)

        versions.make(number, grown)
        versions.show_as(table)

    writer = lines.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_lines(lines: DataFrame, table: str, checkpoint: str, n: int = 200, once: bool = False, path: str | None = None) -> StreamingQuery:
    """Keep a view of the last n lines of each source; every batch makes a new version of what it shows.

    path: where the versions lie (beside the checkpoint).
    """

    def keep(batch: DataFrame, number: int) -> None:
        versions = Versions(batch.sparkSession, path or checkpoint + "-latest")
        new = batch.select("src", "line_idx", "raw")
        versions.make(number, lambda known: tail_lines(new if known is None else known.unionByName(new), n))
        versions.show_as(table)

    writer = lines.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_numbered(lines: DataFrame, path: str, checkpoint: str, once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Append lines(src, rotation, blk, mid, at, raw) of follow_ranges() to parquet files with their line_idx, each once.

    The counts of a batch's ranges, a row each, are added to those of the batches before (a version for each batch); lines stay where they are. A batch that
    runs again writes the same folder again.
    """

    def number(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        totals = Versions(spark, checkpoint + "-counts")
        batch = batch.drop("line_idx")
        # written once, so that the files are read twice in all: for the counts and for the lines
        counts = cut(batch.groupBy("src", "blk").agg(F.count(F.lit(1)).alias("n")), "counts")
        rows = counts.count()
        known = totals.latest(k)
        known = known if known is not None else spark.createDataFrame([], "src string, lines long")
        before = W.partitionBy("src").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
        off = F.coalesce("lines", F.lit(0)) + F.coalesce(F.sum("n").over(before), F.lit(0))
        offsets = counts.join(known, "src", "left").select("src", "blk", off.alias("_off"))
        offsets = F.broadcast(offsets) if rows <= BROADCAST_RANGES else offsets
        out = batch.join(offsets, ["src", "blk"]).withColumn("line_idx", F.col("_off") + F.col("mid")).drop("_off", "blk", "mid")
        out.write.mode("overwrite").parquet(f"{path}/batch={k}")
        totals.make(k, lambda _: counts.select("src", F.col("n").alias("lines")).unionByName(known).groupBy("src").agg(F.sum("lines").alias("lines")))
        drop(counts)

    writer = lines.writeStream.foreachBatch(number).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
