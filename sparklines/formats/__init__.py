"""The registry of formats: a name, how a line becomes parts, and the weight of a parsed line in detection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.formats import clf, common, dlt_text, journal, json, logfmt, otlp, syslog
from sparklines.model import PARTS


@dataclass(frozen=True)
class Format:
    """parts: line to parts struct, NULL if it isn't of the format. weight: of parts, a line's score in detection."""

    name: str
    parts: Callable[[Column], Column]
    weight: Callable[[Column], Column] = lambda parts: F.lit(1.0)


_FORMATS: dict[str, Format] = {}
#: Other readings of formats, taken by name and never detected.
_BY_NAME: dict[str, Callable[[Column], Column]] = {"json_verbatim": json.parse_verbatim}


def register_format(name: str, parts: Callable[[Column], Column], weight: Callable[[Column], Column] | float = 1.0) -> None:
    """Add a format, or replace the one of that name. Of equal scores the format registered last wins."""
    _FORMATS[name] = Format(name, parts, weight if callable(weight) else lambda _: F.lit(float(weight)))


def formats() -> list[Format]:
    return list(_FORMATS.values())


def parse(raw: Column, name: str | None) -> Column:
    """parts of a line in a format; NULL where it doesn't parse, isn't UTF-8, or without a format."""
    if name is None or name == "plain":
        return F.lit(None).cast(PARTS)
    read = _BY_NAME[name] if name in _BY_NAME else _FORMATS[name].parts
    return F.when(F.is_valid_utf8(raw) & (raw != ""), read(raw)).cast(PARTS)


register_format("otlp", otlp.parse, 1.5)
register_format("dlt", dlt_text.parse, 1.2)
register_format("json", json.parse)
register_format("syslog", syslog.parse)
register_format("journalctl", journal.parse)
register_format("clf", clf.parse)
register_format("logfmt", logfmt.parse, lambda p: F.when(logfmt.known_key(p), 1.0).otherwise(0.5))
register_format("common", common.parse, 0.95)
