"""Keep a stream running: restart it after failures, first at once, then after longer and longer waits."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Seconds before the first, second, third and every further attempt.
WAITS = (0, 2, 5, 10)


class _Progress(StreamingQueryListener):
    """Remembers which runs have finished a batch."""

    def __init__(self):
        self.ran: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.ran.add(str(event.progress.runId))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def keep_running(
    spark: SparkSession, start: Callable[[], StreamingQuery], fatal: Callable[[Exception], bool] = lambda e: False, attempts: int | None = None,
    waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep,
) -> int:
    """Run start()'s query to its end, again after each failure, and give the number of failures.

    start: begins the query, always with the same checkpoint, from which a new run goes on; a failure in it counts like one of the query. The waits
    begin anew after a run that finished a batch. fatal: which errors end it at once; they rise. attempts: failures in a row after which the error rises.
    """
    progress, failures, row = _Progress(), 0, 0
    spark.streams.addListener(progress)
    try:
        while True:
            query = None
            try:
                query = start()
                query.awaitTermination()
                return failures
            except Exception as e:
                # errors of the query itself, and those of connecting, are what restarts are for
                if not isinstance(e, StreamingQueryException | OSError) or fatal(e):
                    raise
                failures += 1
                row = 1 if query is not None and str(query.runId) in progress.ran else row + 1
                if attempts is not None and row > attempts:
                    raise
                sleep(waits[min(row, len(waits)) - 1])
    finally:
        spark.streams.removeListener(progress)
