"""The one schema that all log formats are turned into, and the filter definitions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

KV = "array<struct<k:string,v:string>>"
SPAN = f"struct<name:string,fields:{KV}>"
PARTS = f"struct<timestamp:string,level:string,target:string,span:{SPAN},extra:{KV},message:string>"

#: The keys of each slot's group.
TIMESTAMP_KEYS = ("timestamp", "time", "ts", "@timestamp", "datetime", "_SOURCE_REALTIME_TIMESTAMP", "__REALTIME_TIMESTAMP")
LEVEL_KEYS = ("level", "lvl", "severity", "PRIORITY", "log_level")
TARGET_KEYS = ("target", "module", "logger", "source", "component", "service", "name", "SYSLOG_IDENTIFIER", "_COMM", "caller")
MESSAGE_KEYS = ("message", "msg", "log", "text", "MESSAGE", "body", "short_message")

DATE, FIELD = "@date:", "@field:"


@dataclass(frozen=True)
class FilterDef:
    """One entry of an ordered filter list; date and field filters carry their prefix in the pattern."""

    id: int
    pattern: str
    filter_type: str = "Include"
    enabled: bool = True
    color_config: dict | None = field(default=None, hash=False)

    @property
    def include(self) -> bool:
        return self.filter_type == "Include"


def filter_set(*items: tuple[str, str]) -> list[FilterDef]:
    """Definitions from ("Include" | "Exclude", pattern) pairs; a pair given twice counts once."""
    return [FilterDef(i, p, t) for i, (t, p) in enumerate(dict.fromkeys(items))]


def save_filters(filters: list[FilterDef], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump([asdict(x) for x in filters], f, indent=2)


def load_filters(path: str) -> list[FilterDef]:
    with open(path, encoding="utf-8") as f:
        return [FilterDef(**x) for x in json.load(f)]


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(c: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(c, F.lit(""))


def pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.alias("v"))


def pairs(*items: Column) -> Column:
    """Key/value pairs in order, those without a value left out."""
    return F.filter(F.array(*items), lambda x: x["v"].isNotNull()) if items else F.array().cast(KV)


def make_parts(timestamp=None, level=None, target=None, span=None, extra=None, message=None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        text(timestamp).alias("timestamp"), text(level).alias("level"), text(target).alias("target"),
        (F.lit(None) if span is None else span).cast(SPAN).alias("span"),
        (pairs() if extra is None else extra).cast(KV).alias("extra"), text(message).alias("message"),
    )


def first_value(extra: Column, key: str) -> Column:
    """Value of the first pair with the key."""
    return F.get(F.filter(extra, lambda x: x["k"] == key), F.lit(0))["v"]


def groups(raw: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that spans the whole line as an array, NULL if it doesn't match; one regex pass."""
    cut = "".join(f"${i}\u0001" for i in range(1, n + 1))
    parted = F.split(F.regexp_replace(raw, F.lit(f"(?s)^{pattern}$"), F.lit(cut)), "\u0001")
    return F.when((F.size(parted) == n + 1) & ~F.contains(raw, F.lit("\u0001")), parted)
