"""Which lines show: ordered text filters, date filters and field filters compiled to one boolean column."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklines.functions.literals import any_literal
from sparklines.functions.spans import java_pattern
from sparklines.functions.timestamps import MONTHS, canonical, time_of_day
from sparklines.model import DATE, FIELD, PARTS, FilterDef, first_value, let

SPECIAL = set(r".+*?[](){}\^$|")


# ---- text filters


def is_regex(pattern: str) -> bool:
    return any(c in SPECIAL for c in pattern)


def text_match(raw: Column, pattern: str, unicode: bool = False) -> Column:
    """A literal is looked for in the line's bytes; a regex only in lines that are UTF-8. A bad regex raises."""
    if not is_regex(pattern):
        return F.contains(raw, F.lit(pattern))
    return F.is_valid_utf8(raw) & F.rlike(raw, F.lit(java_pattern(pattern, unicode)))


def text_filters(filters: list[FilterDef]) -> list[FilterDef]:
    return [f for f in filters if f.enabled and not f.pattern.startswith((DATE, FIELD))]


def text_vote(raw: Column, filters: list[FilterDef]) -> Column:
    """'I' or 'E' by the first filter in order that matches, NULL if none does."""
    votes = [(text_match(raw, f.pattern), "I" if f.include else "E") for f in text_filters(filters)]
    if not votes:
        return F.lit(None).cast("string")
    if len(votes) > 64:  # a long CASE outgrows a compiled method; an array of matches doesn't
        at = F.array_position(F.array(*[F.coalesce(m, F.lit(False)) for m, _ in votes]), True).cast("int")
        return F.get(F.array(*[F.lit(v) for _, v in votes]), at - 1)
    out = F.when(votes[0][0], F.lit(votes[0][1]))
    for m, v in votes[1:]:
        out = out.when(m, F.lit(v))
    return out


#: Literals that are looked for one by one; more of them by an index of grams, which costs as much for thousands as for few.
FEW_LITERALS = 64


def match_any_literal(raw: Column, literals: list[str]) -> Column:
    """Whether any of the literals occurs; substring searches up to FEW_LITERALS, beyond it one pass over the line's bytes in Arrow batches."""
    if len(literals) <= FEW_LITERALS:
        return reduce(or_, [F.contains(raw, F.lit(x)) for x in literals], F.lit(False))
    return any_literal(raw, literals)


# ---- date filters


@dataclass(frozen=True)
class Bound:
    """A moment: seconds of the day, or canonical text; unit is what was written: day, minute or second."""

    seconds: int | None
    text: str | None
    unit: str


@dataclass(frozen=True)
class DateFilter:
    """low <= t <= high, or t op low."""

    op: str
    low: Bound
    high: Bound | None = None


def _time(s: str) -> tuple[int, str] | None:
    m = re.fullmatch(r"(\d\d):(\d\d)(?::(\d\d))?", s, re.ASCII)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3] or 0) > 59:
        return None
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0), "second" if m[3] else "minute"


def parse_bound(text: str) -> Bound:
    s = text.strip()
    if not s:
        raise ValueError("empty date or time")
    if t := _time(s):
        return Bound(t[0], None, t[1])
    names = [m.lower() for m in MONTHS]
    if s[:3].lower() in names and (m := re.fullmatch(r"...[ /]*(\d+)\s*(.*)", s, re.ASCII)):
        year, month, day, rest = 0, names.index(s[:3].lower()) + 1, int(m[1]), m[2]
    elif m := re.fullmatch(r"(\d\d)([/-])(\d\d)(?:\2(\d{4}))?(?!\2)\s*(.*)", s, re.ASCII):
        year, month, day, rest = int(m[4] or 0), int(m[1]), int(m[3]), m[5]
    elif m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)(?:[T ](.+))?", s, re.ASCII):
        year, month, day, rest = int(m[1]), int(m[2]), int(m[3]), m[4] or ""
    else:
        raise ValueError(f"not a date or time: {text!r}")
    if not 1 <= month <= 12 or not 1 <= day <= 31:
        raise ValueError(f"month or day out of range: {text!r}")
    t = _time(rest) if rest else (0, "day")
    if t is None:
        raise ValueError(f"bad time in {text!r}")
    return Bound(None, f"{year:04d}-{month:02d}-{day:02d} {t[0] // 3600:02d}:{t[0] // 60 % 60:02d}:{t[0] % 60:02d}.000000", t[1])


def _to_end(b: Bound) -> Bound:
    """The last moment of the written unit."""
    if b.text is None:
        return Bound(b.seconds + (59 if b.unit == "minute" else 0), None, b.unit)
    tail = {"day": "23:59:59.999999", "minute": b.text[11:17] + "59.999999", "second": b.text[11:]}[b.unit]
    return Bound(None, b.text[:11] + tail, b.unit)


def parse_date_filter(text: str) -> DateFilter:
    """`a .. b` (both ends included), `> >= < <=` with a bound, or a bound that stands for its whole unit.

    The upper end of a range grows to the end of its unit; the bound of a comparison doesn't.
    """
    s = text.strip()
    if not s:
        raise ValueError("empty date filter")
    if ".." in s:
        low, high = (parse_bound(x) for x in s.split("..", 1))
        if (low.text is None) != (high.text is None):
            raise ValueError("a range can't mix times and dates")
        if (low.seconds or 0, low.text or "") > (high.seconds or 0, high.text or ""):
            raise ValueError("the range ends before it starts")
        return DateFilter("..", low, _to_end(high))
    for op in (">=", "<=", ">", "<"):
        if s.startswith(op):
            return DateFilter(op, parse_bound(s[len(op) :]))
    b = parse_bound(s)
    return DateFilter("..", b, _to_end(b))


def date_match(canon: Column, f: DateFilter) -> Column:
    """Whether a canonical timestamp passes; one that isn't known passes."""
    if f.low.text is None:
        value, low, high = time_of_day(canon), f.low.seconds, f.high and f.high.seconds
    else:
        value, low, high = canon, f.low.text, f.high and f.high.text
        if low.startswith("0000-"):
            value, low, high = F.substring(canon, 6, 30), low[5:], high and high[5:]
    hit = {"..": lambda: value.between(low, high), ">": lambda: value > low, ">=": lambda: value >= low, "<": lambda: value < low, "<=": lambda: value <= low}[f.op]()
    return F.coalesce(hit, F.lit(True))


def date_filters(filters: list[FilterDef]) -> list[DateFilter]:
    return [parse_date_filter(f.pattern[len(DATE) :]) for f in filters if f.enabled and f.pattern.startswith(DATE)]


# ---- field filters


def parse_field_filter(text: str, mark: str = ":") -> tuple[str, str]:
    """(field, value) around the first mark; neither may be empty."""
    key, _, value = text.partition(mark)
    if not key or not value:
        raise ValueError(f"not a field filter: {text!r}")
    return key, value


def resolve_field(parts: Column, name: str) -> Column:
    """Value of a field by its name or alias; NULL if the line hasn't got it."""
    for slot, names in {"level": ("level", "lvl"), "timestamp": ("timestamp", "ts", "time"), "target": ("target",), "message": ("message", "msg")}.items():
        if name in names:
            return parts[slot]
    if name == "span.name":
        return parts["span"]["name"]
    if name.startswith("span."):
        return first_value(parts["span"]["fields"], name[5:])
    return first_value(parts["extra"], name.removeprefix("fields."))


def field_filters(filters: list[FilterDef], include: bool) -> list[tuple[str, str]]:
    return [parse_field_filter(f.pattern[len(FIELD) :]) for f in filters if f.enabled and f.include == include and f.pattern.startswith(FIELD)]


def field_match(parts: Column, key: str, value: str) -> Column:
    return F.coalesce(F.contains(resolve_field(parts, key), F.lit(value)), F.lit(False))


def field_include_vote(parts: Column, filters: list[FilterDef], mode: str = "any") -> Column:
    """True or False of a parsed line (an absent field doesn't match), NULL of an unparsed one or without includes."""
    wanted = [field_match(parts, k, v) for k, v in field_filters(filters, True)]
    if not wanted:
        return F.lit(None).cast("boolean")
    hit = reduce(or_, wanted) if mode == "any" else reduce(lambda a, b: a & b, wanted)
    return F.when(parts.isNotNull(), hit)


def field_exclude(parts: Column, filters: list[FilterDef]) -> Column:
    return reduce(or_, [field_match(parts, k, v) for k, v in field_filters(filters, False)], F.lit(False))


# ---- together


def needs_parts(filters: list[FilterDef]) -> bool:
    return any(f.enabled and f.pattern.startswith((DATE, FIELD)) for f in filters)


def date_pass(parts: Column, filters: list[FilterDef]) -> Column:
    """True if any date filter passes; also without date filters or without a timestamp."""
    dates = date_filters(filters)
    if not dates:
        return F.lit(True)
    ts = parts["timestamp"]
    return ts.isNull() | let(canonical(ts), lambda c: reduce(or_, [date_match(c, d) for d in dates]))


def visible(raw: Column, parts: Column, filters: list[FilterDef], field_mode: str = "any", on: bool = True) -> Column:
    """Whether a line shows. The order of the steps matters: an excluding text vote hides, then dates, then field
    excludes; an including vote shows; then field includes decide; else lines show if no text filter includes.
    """
    if not on or not any(f.enabled for f in filters):
        return F.lit(True)
    no_include = F.lit(not any(f.include for f in text_filters(filters)))
    includes = bool(field_filters(filters, True))

    def decide(vote: Column, p: Column) -> Column:
        out = F.when(vote.eqNullSafe("E"), F.lit(False))
        if date_filters(filters):
            out = out.when(~date_pass(p, filters), F.lit(False))
        if field_filters(filters, False):
            out = out.when(field_exclude(p, filters), F.lit(False))
        out = out.when(vote.eqNullSafe("I"), F.lit(True))
        return out.otherwise(F.coalesce(field_include_vote(p, filters, field_mode), no_include) if includes else no_include)

    # the vote and, unless it excludes, the parts are computed once, however many filters look at them
    vote = text_vote(raw, filters)
    once = lambda v: let(F.when(~v.eqNullSafe("E"), parts), lambda p: decide(v, p)) if needs_parts(filters) else decide(v, parts)
    return let(vote, once) if text_filters(filters) else once(vote)


def visible_lines(lines: DataFrame, filters: list[FilterDef] | dict[str, list[FilterDef]], **options) -> DataFrame:
    """The lines(src, line_idx, raw[, parts]) that show; a dict gives each src a list of its own (others show whole)."""
    parts = F.col("parts") if "parts" in lines.columns else F.lit(None).cast(PARTS)
    if isinstance(filters, list) and "parts" in lines.columns and needs_parts(filters) and options.get("on", True):
        # a generated row holds the parts as a value, which compiled code computes once; a filter alone would repeat the parsing
        vote = text_vote(F.col("raw"), filters)
        lines = lines.withColumn("parts", F.explode(F.array(F.when(~vote.eqNullSafe("E"), parts))))
    if isinstance(filters, list):
        return lines.filter(visible(F.col("raw"), parts, filters, **options))
    show = F.lit(True)
    for src, own in filters.items():
        show = F.when(F.col("src") == src, visible(F.col("raw"), parts, own, **options)).otherwise(show)
    return lines.filter(show)


def filter_hits(raw: Column, parts: Column, filters: list[FilterDef]) -> list[tuple[FilterDef, Column]]:
    """Each enabled filter with whether it counts a line, whatever the order of the filters.

    Date filters count lines with a timestamp whose text vote isn't 'E'; field filters count parsed lines.
    """
    vote, found = text_vote(raw, filters), []
    for f in (f for f in filters if f.enabled):
        if f.pattern.startswith(DATE):
            ts = parts["timestamp"]
            hit = ~vote.eqNullSafe("E") & ts.isNotNull() & date_match(canonical(ts), parse_date_filter(f.pattern[len(DATE) :]))
        elif f.pattern.startswith(FIELD):
            hit = field_match(parts, *parse_field_filter(f.pattern[len(FIELD) :]))
        else:
            hit = text_match(raw, f.pattern)
        found.append((f, hit))
    return found


def filter_counts(lines: DataFrame, filters: list[FilterDef]) -> DataFrame:
    """(id, pattern, n): lines that each enabled filter counts, in one pass."""
    found = filter_hits(F.col("raw"), F.col("parts") if "parts" in lines.columns else F.lit(None).cast(PARTS), filters)
    if not found:
        return lines.sparkSession.createDataFrame([], "id int, pattern string, n long")
    counted = lines.agg(*[F.count_if(hit).alias(f"c{i}") for i, (_, hit) in enumerate(found)])
    rows = F.array(*[F.struct(F.lit(f.id).alias("id"), F.lit(f.pattern).alias("pattern"), F.col(f"c{i}").alias("n")) for i, (f, _) in enumerate(found)])
    return counted.select(F.inline(rows))
