"""Well-known values in a text: methods, status codes, addresses, UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.functions.spans import SPANS, find_spans, resolve_overlaps

#: The patterns of the classes. A status doesn't touch "." or "/", an address doesn't follow "/".
METHOD = r"\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"
STATUS = r"(?<![./])\b[1-5][0-9]{2}\b(?![./])"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = r"(?<!/)\b(?=[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b)" + r"\.".join([OCTET] * 4) + r"\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
IPV6 = (
    r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b"
    r"|\b(?:[0-9a-f]{1,4}:){1,7}:\b"
    r"|\b(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}\b"
    r"|\b(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}\b"
    r"|\b(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}\b"
    r"|\b(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}\b"
    r"|\b(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}\b"
    r"|\b[0-9a-f]{1,4}:(?::[0-9a-f]{1,4}){1,6}\b"
    r"|::(?:[0-9a-f]{1,4}:){0,5}[0-9a-f]{1,4}\b"
    r"|\b(?:[0-9a-f]{1,4}:){1,5}:(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
    r"|::1\b"
)


def _classed(text: Column, pattern: str, name, guard: Column | None = None) -> Column:
    """Spans with their class; name gives it from the matched text. guard: a cheap test that every text with a match passes."""
    found = find_spans(text, pattern, "chars")
    found = F.when(guard if guard is not None else F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(SPANS))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), name(F.substring(text, x["s"] + 1, x["e"] - x["s"])).alias("tag")))


def _method(m: Column) -> Column:
    return F.when(m.isin("GET", "POST", "PUT", "DELETE", "PATCH"), F.concat(F.lit("http_"), F.lower(m))).otherwise(F.lit("http_other"))


def value_spans(text: Column, disabled: tuple[str, ...] = ()) -> Column:
    """array<struct<s, e, tag>> of the values in a text, in characters, without overlaps.

    Classes switched off by key (http_get ... uuid) are left out before overlaps are settled; 1xx codes have none.
    """
    colons = F.char_length(text) - F.char_length(F.replace(text, F.lit(":"), F.lit("")))
    every = F.concat(
        _classed(text, METHOD, _method),
        _classed(text, STATUS, lambda m: F.concat(F.lit("status_"), F.substring(m, 1, 1), F.lit("xx")), F.rlike(text, F.lit("[0-9]{3}"))),
        _classed(text, IPV4, lambda m: F.lit("ip_address"), F.rlike(text, F.lit(r"\.[0-9]{1,3}\.[0-9]{1,3}\."))),
        _classed(text, UUID, lambda m: F.lit("uuid"), F.rlike(text, F.lit("-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"))),
        _classed(text, IPV6, lambda m: F.lit("ip_address"), F.contains(text, F.lit("::")) | (colons >= 7)),
    )
    off = F.array(*[F.lit(d) for d in ("status_1xx", *disabled)])
    return resolve_overlaps(F.filter(every, lambda x: ~F.array_contains(off, x["tag"])))
