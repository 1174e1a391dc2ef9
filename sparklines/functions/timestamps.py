"""Recognising timestamps, and one text form to compare them in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.model import let

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH = "(?:" + "|".join(MONTHS) + ")"
WEEKDAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
HMS = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
#: Fragments for the formats' patterns.
ISO = r"[0-9]{4}-[^ ]{5}T[^ ]*+"
BSD = rf"{MONTH} (?: [0-9]|[0-9]{{2}}) {HMS}"
BSD_PRECISE = rf"{BSD}\.[0-9]++"
FULL = rf"{WEEKDAY} [0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {HMS} [^ ]++"
DATETIME = rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {HMS}(?:[.,][0-9]*+)?(?:Z|[+-][0-9:]{{2,}}+)?"


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(name))
    return F.lpad(at.cast("string"), 2, "0")


def _clock(text: Column) -> Column:
    """HH:MM:SS.ffffff of a text that starts with a time; the fraction is padded or cut to six digits."""
    frac = F.regexp_extract(text, r"^[0-9:]{8}[.,]([0-9]*)", 1)
    return F.concat(F.substring(text, 1, 8), F.lit("."), F.rpad(F.substring(frac, 1, 6), 6, "0"))


def canonical(ts: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS.ffffff` of a log timestamp, year 0000 if it has none, NULL if it isn't recognised.

    Zones are ignored. Text, not TIMESTAMP: year 0 and days like Feb 30 must survive.
    """

    def body(t: Column) -> Column:
        date = F.replace(F.substring(t, 1, 10), F.lit("/"), F.lit("-"))
        bsd = rf"^({MONTH}) *([0-9]+) +({HMS}.*)$"
        apache = rf"^\[{WEEKDAY} ({MONTH}) *([0-9]+) +({HMS}(?:\.[0-9]*)?) *([0-9]+) *\]$"
        two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
        part = lambda p, i: F.regexp_extract(t, p, i)
        return (
            F.when(F.rlike(t, F.lit(rf"^[0-9]{{4}}-.{{5}}T{HMS}")), F.concat(date, F.lit(" "), _clock(F.substring(t, 12, 100))))
            .when(F.rlike(t, F.lit(rf"^[0-9]{{4}}([-/])[0-9]{{2}}\1[0-9]{{2}} {HMS}")), F.concat(date, F.lit(" "), _clock(F.substring(t, 12, 100))))
            .when(F.rlike(t, F.lit(rf"^{WEEKDAY} [0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {HMS}")), F.concat(F.substring(t, 5, 10), F.lit(" "), _clock(F.substring(t, 16, 100))))
            .when(
                F.rlike(t, F.lit(rf"^[0-9]{{2}}/{MONTH}/[0-9]{{4}}:{HMS}")),
                F.concat(F.substring(t, 8, 4), F.lit("-"), _month(F.substring(t, 4, 3)), F.lit("-"), F.substring(t, 1, 2), F.lit(" "), _clock(F.substring(t, 13, 100))),
            )
            .when(F.rlike(t, F.lit(bsd)), F.concat(F.lit("0000-"), _month(part(bsd, 1)), F.lit("-"), two(part(bsd, 2)), F.lit(" "), _clock(part(bsd, 3))))
            .when(
                F.rlike(t, F.lit(apache)),
                F.concat(F.lpad(part(apache, 4), 4, "0"), F.lit("-"), _month(part(apache, 1)), F.lit("-"), two(part(apache, 2)), F.lit(" "), _clock(part(apache, 3))),
            )
        )

    return let(ts, body)


def time_of_day(canon: Column) -> Column:
    """Seconds since midnight of a canonical timestamp."""
    at = lambda i: F.substring(canon, i, 2).try_cast("int")
    return at(12) * 3600 + at(15) * 60 + at(18)


def event_time(ts: Column, canon: Column) -> Column:
    """TIMESTAMP of a log timestamp: from nanoseconds since 1970, else from its canonical text; NULL without a year."""
    nanos = F.when(F.rlike(ts, F.lit("^[0-9]{16,20}$")), F.timestamp_micros((ts.try_cast("decimal(20,0)") / 1000).cast("long")))
    return F.coalesce(nanos, F.when(~F.startswith(canon, F.lit("0000")), F.try_to_timestamp(canon, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))))
