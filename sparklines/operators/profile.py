"""Which fields the lines of a source have, and which values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklines.formats.json import entries_of
from sparklines.functions.spans import quote
from sparklines.model import LEVEL_KEYS, MESSAGE_KEYS, TARGET_KEYS, TIMESTAMP_KEYS

#: What the text form of diagnostic logs always has.
DLT_NAMES = ("timestamp", "level", "target", "hw_ts", "mcnt", "ecu", "ctid", "type", "subtype", "mode", "message")
#: Slots that these formats list whether or not a line fills them.
ALWAYS = {
    "otlp": ("timestamp", "level", "target", "message"), "syslog": ("timestamp", "level", "target", "message"),
    "journalctl": ("timestamp", "target", "message"), "clf": ("timestamp", "target", "message"),
}
_FIELDS = "array<struct<name:string,value:string,rank:int>>"


def _group(k: Column) -> Column:
    """0 to 4: timestamp, level, target, extra, message."""
    out = F.when(k.isin(*TIMESTAMP_KEYS), 0).when(k.isin(*LEVEL_KEYS), 1)
    return out.when(k.isin(*TARGET_KEYS), 2).when(k.isin(*MESSAGE_KEYS), 4).otherwise(3)


def line_fields(lines: DataFrame, format: str) -> DataFrame:
    """(src, line_idx, pos, name, value, rank): every field of a parsed line under the name it is listed by.

    JSON lists raw keys, with those inside `fields` and `span` dotted; the others list slots and extras.
    """
    p = F.col("parts")
    one = lambda name, value, rank: F.when(value.isNotNull(), F.array(F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(rank).alias("rank")))).otherwise(F.array().cast(_FIELDS))
    of = lambda kv, prefix: F.transform(kv, lambda x: F.struct(F.concat(F.lit(prefix), x["k"]).alias("name"), x["v"].alias("value"), F.lit(3).alias("rank")))
    if format == "json":

        def spread(e: Column) -> Column:
            inner = F.transform(entries_of(e["v"], False), lambda x: F.struct(F.concat(e["k"], F.lit("."), x["k"]).alias("name"), x["v"].alias("value"), F.lit(3).alias("rank")))
            plain = F.array(F.struct(e["k"].alias("name"), e["v"].alias("value"), _group(e["k"]).alias("rank")))
            nested = e["k"].isin("fields", "span") & F.startswith(e["v"], F.lit("{"))
            return F.when(e["k"] == "spans", F.array().cast(_FIELDS)).when(nested, F.coalesce(inner, F.array().cast(_FIELDS))).otherwise(plain)

        every = F.flatten(F.transform(entries_of(F.col("raw"), True), spread))
    else:
        span = F.coalesce(of(p["span"]["fields"], "span."), F.array().cast(_FIELDS))
        every = F.concat(
            one("timestamp", p["timestamp"], 0), one("level", p["level"], 1), one("span", p["span"]["name"], 1), one("target", p["target"], 2),
            span, of(p["extra"], ""), one("message", p["message"], 4),
        )
    rows = lines.filter(p.isNotNull()).select("src", "line_idx", F.posexplode(every).alias("pos", "f"))
    return rows.select("src", "line_idx", "pos", "f.name", "f.value", "f.rank")


def field_names(lines: DataFrame, format: str, sample: int | None = 200) -> DataFrame:
    """(src, name, position): names in order: timestamp, level, target, extras sorted (clf: as first seen), message."""
    head = lines.filter(F.col("line_idx") < sample) if sample else lines
    if format == "dlt":
        names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("position")) for i, n in enumerate(DLT_NAMES)])
        return head.select("src").distinct().select("src", F.inline(names))
    found = line_fields(head, format).groupBy("src", "name").agg(F.min("rank").alias("rank"), F.min(F.struct("line_idx", "pos")).alias("at"))
    if format in ALWAYS:
        ranks = {"timestamp": 0, "level": 1, "target": 2, "message": 4}
        fixed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(ranks[n]).alias("rank")) for n in ALWAYS[format]])
        listed = lines.select("src").distinct().select("src", F.inline(fixed))
        extras = found.filter("rank = 3").select("src", "name", "rank", "at")
        found = extras.unionByName(listed, allowMissingColumns=True)
    seen = F.col("rank") != 3 if format != "clf" else F.lit(True)
    order = W.partitionBy("src").orderBy("rank", F.when(seen, F.col("at")).asc_nulls_first(), F.when(F.col("name") == "span", 0).otherwise(1), "name")
    return found.select("src", "name", (F.row_number().over(order) - 1).alias("position"))


def field_values(lines: DataFrame, format: str, sample: int | None = None) -> DataFrame:
    """(src, name, value, n): every value of each field but timestamps and messages, with its number; a row each, in no order."""
    head = lines.filter(F.col("line_idx") < sample) if sample else lines
    unlisted = ("span", *TIMESTAMP_KEYS, *MESSAGE_KEYS)
    return line_fields(head, format).filter(~F.col("name").isin(*unlisted)).groupBy("src", "name", "value").agg(F.count(F.lit(1)).alias("n"))


def field_index(lines: DataFrame, format: str, sample: int | None = None, exact: bool = True) -> DataFrame:
    """(src, name, n, n_values, low, high): lines that have each field, the number of its values, the first and last of them.

    Timestamps and messages list no values. exact False estimates the number of values, which spares grouping by value.
    """
    head = lines.filter(F.col("line_idx") < sample) if sample else lines
    listed = F.when(~F.col("name").isin(*TIMESTAMP_KEYS, *MESSAGE_KEYS), F.col("value"))
    fields = line_fields(head, format).filter("name <> 'span'").withColumn("value", listed)
    ends = [F.min("value").alias("low"), F.max("value").alias("high")]
    if not exact:
        return fields.groupBy("src", "name").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("value").alias("n_values"), *ends)
    once = fields.groupBy("src", "name", "value").agg(F.count(F.lit(1)).alias("n"))  # a line has a name once but for repeats
    return once.groupBy("src", "name").agg(F.sum("n").alias("n"), F.count("value").alias("n_values"), *ends)


def fuzzy(column: Column, query: str) -> Column:
    """Whether the query's characters occur in order, any case."""
    return F.rlike(column, F.lit("(?is)" + ".*".join(quote(c) for c in query))) if query else F.lit(True)
