"""Tables of which every batch of a stream writes a version: a repeated or torn batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparklines.shared import hadoop


class Versions:
    """Versions of a table in folders of a shared path, by the number of the batch that made them; the last complete one counts.

    A batch's version is made from the last complete one of an earlier batch. So a batch that runs again, after a crash at any point, makes the same version
    again, over whatever the crash has left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def complete(self) -> list[int]:
        """Numbers of the versions that were written to their end."""
        root, fs = hadoop(self.spark, self.path)
        if not fs.exists(root):
            return []
        folders = [s.getPath() for s in fs.listStatus(root)]
        done = [p for p in folders if p.getName().startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def folder(self, number: int) -> str:
        return f"{self.path}/v{number}"

    def latest(self, before: int | None = None) -> DataFrame | None:
        """The last complete version, of those before a number if given."""
        found = [v for v in self.complete() if before is None or v < before]
        return self.spark.read.parquet(self.folder(found[-1])) if found else None

    def make(self, number: int, fn: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
        """Write fn(the version before) as the version of a batch; versions before that one go."""
        earlier = [v for v in self.complete() if v < number]
        fn(self.latest(number)).write.mode("overwrite").parquet(self.folder(number))
        for v in earlier[:-1]:
            p, fs = hadoop(self.spark, self.folder(v))
            fs.delete(p, True)
        return self.spark.read.parquet(self.folder(number))

    def show_as(self, view: str) -> None:
        """Let a view of the catalogue show the last complete version; replacing it is one step."""
        found = self.complete()
        if found:
            self.spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{self.folder(found[-1])}`")
