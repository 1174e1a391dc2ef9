"""The family of lines that begin with a timestamp, a level and a target, one layout for each logging library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.functions.levels import LEVEL, normalize_level
from sparklines.functions.timestamps import DATETIME, ISO
from sparklines.model import KV, blank, groups, let, make_parts, pair, pairs

_TS = rf"((?=.{{19}}){ISO}|{DATETIME})"


def _layout(raw: Column, pattern: str, n: int, build) -> Column:
    return let(groups(raw, pattern, n), lambda g: F.when(g.isNotNull(), build(g)))


def _split(rest: Column, *marks: str) -> Column:
    """struct<target, message> around the first of the marks that occurs; else all is message."""
    out = F.struct(F.lit(None).cast("string").alias("target"), blank(rest).alias("message"))
    for mark in reversed(marks):
        at = F.locate(mark, rest)
        both = F.struct(blank(F.trim(F.substring(rest, F.lit(1), at - 1))).alias("target"), blank(F.substring(rest, at + len(mark), F.length(rest))).alias("message"))
        out = F.when(at > 0, both).otherwise(out)
    return out


def spring_boot(raw: Column) -> Column:
    line = rf"({DATETIME}) *+({LEVEL}) +([0-9]*+) +--- \[([^\]]*+)\] *+(.*)"
    return _layout(raw, line, 5, lambda g: let(_split(g[4], " : "), lambda x: make_parts(g[0], normalize_level(g[1]), x["target"], None, pairs(pair("pid", g[2]), pair("thread", F.trim(g[3]))), x["message"])))


def logback(raw: Column) -> Column:
    line = rf"({DATETIME}) *+\[([^\]]*+)\] *+({LEVEL}) +(.*)"
    return _layout(raw, line, 4, lambda g: let(_split(g[3], " - ", " : "), lambda x: make_parts(g[0], normalize_level(g[2]), x["target"], None, pairs(pair("thread", g[1])), x["message"])))


def loguru(raw: Column) -> Column:
    line = rf"({DATETIME}) \| *+({LEVEL}) +\| (.*)"
    return _layout(raw, line, 3, lambda g: let(_split(g[2], " - "), lambda x: make_parts(g[0], normalize_level(g[1]), x["target"], None, None, x["message"])))


def structlog(raw: Column) -> Column:
    return _layout(raw, rf"({DATETIME}) *+\[ *+({LEVEL}) *+\] *+(.*)", 3, lambda g: make_parts(g[0], normalize_level(g[1]), message=blank(g[2])))


def env_logger(raw: Column) -> Column:
    line = rf"\[(?:{_TS} *+(?= ?))?({LEVEL})(?: +([^ \]]+)([^\]]*+))? *+\] ?(.*)"

    def build(g: Column) -> Column:
        return make_parts(blank(g[0]), normalize_level(g[1]), blank(g[2]), None, None, blank(g[4]))

    return _layout(raw, line, 5, build)


def python_prod(raw: Column) -> Column:
    return _layout(raw, rf"({DATETIME}) - ((?:(?! - ).)*+) - ({LEVEL}) - (.*)", 4, lambda g: make_parts(g[0], normalize_level(g[2]), blank(g[1]), None, None, blank(g[3])))


def tracing(raw: Column) -> Column:
    line = rf"(?=.{{19}})({ISO}) *+({LEVEL}) +([A-Za-z0-9_]+)\{{([^}}]*+)\}}: (.*)"

    def build(g: Column) -> Column:
        field = r'([^=]+?)=(?:"([^"]*)"?|([^ ]*))(?: +|$)'
        all_of = lambda i: F.regexp_extract_all(F.trim(g[3]), F.lit(field), F.lit(i))
        values = F.zip_with(all_of(2), all_of(3), lambda a, b: F.concat(a, b))
        fields = F.zip_with(all_of(1), values, lambda k, v: F.struct(F.trim(k).alias("k"), v.alias("v"))).cast(KV)
        span = F.struct(g[2].alias("name"), fields.alias("fields"))
        return let(_split(g[4], ": "), lambda x: make_parts(g[0], normalize_level(g[1]), x["target"], span, None, x["message"]))

    return _layout(raw, line, 5, build)


def generic(raw: Column) -> Column:
    """Timestamp, level, then a target before `:: `, `: ` or ` - ` if what stands there can be one."""

    def build(g: Column) -> Column:
        rest = F.ltrim(g[2])
        not_level = rf"(?!{LEVEL}(?:: | - | ))"
        marks = (
            r"([A-Za-z0-9_:-]+?):: (.*)",
            rf"{not_level}((?:(?!: )[^ ])+): (.*)",
            rf"{not_level}((?:(?! - )[^ ])+) - (.*)",
        )
        found = F.coalesce(*[groups(rest, m, 2) for m in marks], F.array(F.lit(""), rest))
        return let(found, lambda x: make_parts(g[0], normalize_level(g[1]), blank(x[0]), None, None, blank(x[1])))

    return _layout(raw, rf"{_TS} *+({LEVEL})(?: (.*))?", 3, build)


def python_basic(raw: Column) -> Column:
    return _layout(raw, rf"({LEVEL}):(?:([^:]*+):)?(.*)", 3, lambda g: make_parts(None, normalize_level(g[0]), blank(g[1]), None, None, blank(g[2])))


LAYOUTS = (spring_boot, logback, loguru, structlog, env_logger, python_prod, tracing, generic, python_basic)


def parse(raw: Column) -> Column:
    return F.coalesce(*[f(raw) for f in LAYOUTS])
