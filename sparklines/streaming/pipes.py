"""Lines of pipes whose records may be cut anywhere: each source's unfinished line and line count are state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Lines handed on at once.
PART = 1 << 16
STATE = "partial binary, n long"


def whole_lines(records: DataFrame, order: str | Column, value: str = "value", src: str | Column | None = None, end: str | Column | None = None) -> DataFrame:
    """Streaming lines(src, line_idx, raw) of records(value) that are pieces of each source's text, as pipes and processes give them.

    order: what puts a source's records in order (an offset, a number, a time of arrival). A line goes on when its line feed has come; the rest is held, over batches and
    restarts. end: true for the last record of a source, after which what is held is a line too; a source that goes on later counts on.
    Null values say nothing. A batch's records of one source are worked on together, so the source's rate limit bounds memory; sources are
    worked on apart. Only a line feed ends a line; carriage returns are dropped.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    keyed = records.select(
        (F.lit("stream") if src is None else column(src)).cast("string").alias("src"), column(order).alias("_order"), F.col(value).cast("binary").alias("_value"),
        (F.lit(False) if end is None else F.coalesce(column(end), F.lit(False))).alias("_end"),
    )

    def joined(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        partial, n = state.get if state.exists else (b"", 0)
        rows = pd.concat(list(parts)).sort_values("_order", kind="stable")
        for ended, group in rows.groupby(rows["_end"].shift(fill_value=False).cumsum(), sort=True):
            lines = b"".join([bytes(partial or b""), *(bytes(v) for v in group["_value"] if v is not None)]).split(b"\n")
            partial = lines.pop()
            if group["_end"].iloc[-1] and partial:
                lines.append(partial)
                partial = b""
            for a in range(0, len(lines), PART):
                some = [x.replace(b"\r", b"") for x in lines[a : a + PART]]
                yield pd.DataFrame({"src": key[0], "line_idx": range(n + a, n + a + len(some)), "raw": some})
            n += len(lines)
        state.update((partial, n))

    out = keyed.groupBy("src").applyInPandasWithState(joined, "src string, line_idx long, raw binary", STATE, "append", GroupStateTimeout.NoTimeout)
    return out.select("src", "line_idx", F.col("raw").cast("string").alias("raw"))
