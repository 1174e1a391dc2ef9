"""Folders that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own; a temporary one only on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sparklines-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """The path of a new folder that all executors share; it is deleted when the JVM ends."""
    path = f"{checkpoint_root(spark)}/sparklines/{tag}-{uuid.uuid4().hex}"
    p, fs = hadoop(spark, path)
    fs.deleteOnExit(p)
    return path


def cut(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder, in folders by a column if asked, and read it back: later stages don't recompute it, also when executors are lost."""
    path = new_folder(df.sparkSession, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """A path and its file system as Spark's JVM sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote and nobody reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p, fs = hadoop(spark, folder)
        fs.delete(p, True)
