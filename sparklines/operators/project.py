"""Columns of a parsed line and the text it is shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.model import LEVEL_KEYS, MESSAGE_KEYS, TARGET_KEYS, TIMESTAMP_KEYS, first_value, let


def _padded(level: Column) -> Column:
    return F.rpad(level, F.greatest(F.length(level), F.lit(5)), F.lit(" "))


def _pairs_text(kv: Column, keys: bool) -> Column:
    return F.transform(kv, lambda p: F.concat(p["k"], F.lit("="), p["v"]) if keys else p["v"])


def span_text(span: Column, hidden: tuple[str, ...] = (), keys: bool = True) -> Column:
    """`name: k=v k=v` of a span, without the hidden keys."""
    shown = F.filter(span["fields"], lambda p: ~p["k"].isin(*hidden)) if hidden else span["fields"]
    return let(_pairs_text(shown, keys), lambda t: F.when(F.size(t) > 0, F.concat(span["name"], F.lit(": "), F.array_join(t, " "))).otherwise(span["name"]))


def column(parts: Column, name: str, keys: bool = False, hidden: tuple[str, ...] = ()) -> Column:
    """One column by name or alias; NULL if the line hasn't got it."""
    if name == "span":
        return F.when(parts["span"].isNotNull(), span_text(parts["span"], hidden, keys))
    if name.startswith("span."):
        return parts["span"]["name"] if name == "span.name" else first_value(parts["span"]["fields"], name[5:])
    if name.startswith("fields."):
        return parts["message"] if name[7:] in MESSAGE_KEYS else first_value(parts["extra"], name[7:])
    if name in LEVEL_KEYS:
        return _padded(parts["level"])
    for slot, names in (("timestamp", TIMESTAMP_KEYS), ("target", TARGET_KEYS), ("message", MESSAGE_KEYS)):
        if name in names:
            return parts[slot]
    return first_value(parts["extra"], name)


def columns(parts: Column, layout: list[str] | None = None, hidden: tuple[str, ...] = (), keys: bool = False) -> Column:
    """array<string> of the columns that show, in order; layout None: timestamp, level, target, span, extras, message."""
    spans = tuple(h[5:] for h in hidden if h.startswith("span."))
    if layout is not None:
        return F.array_compact(F.array(*[column(parts, n, keys, spans) for n in layout if n not in hidden], F.lit(None).cast("string")))
    gone = lambda names: any(n in hidden for n in names)
    head = [
        *([] if gone(TIMESTAMP_KEYS) else [parts["timestamp"]]), *([] if gone(LEVEL_KEYS) else [_padded(parts["level"])]),
        *([] if gone(TARGET_KEYS) else [parts["target"]]), *([] if "span" in hidden else [column(parts, "span", keys, spans)]),
        F.lit(None).cast("string"),
    ]
    extra = F.filter(parts["extra"], lambda p: ~p["k"].isin(*hidden)) if hidden else parts["extra"]
    tail = F.array(F.lit(None).cast("string") if gone(MESSAGE_KEYS) else parts["message"])
    return F.array_compact(F.concat(F.array(*head), F.coalesce(_pairs_text(extra, keys), F.array().cast("array<string>")), tail))


def display_text(raw: Column, parts: Column, layout: list[str] | None = None, hidden: tuple[str, ...] = (), keys: bool = False) -> Column:
    """The columns joined by a space; the raw line if it isn't parsed or nothing is left."""
    return let(columns(parts, layout, hidden, keys), lambda c: F.when(parts.isNotNull() & (F.size(c) > 0), F.array_join(c, " ")).otherwise(raw))
