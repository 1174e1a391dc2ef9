"""Places of all matches of a pattern in a text, as running sums of sizes."""

from __future__ import annotations

import re
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklines.model import let

SPANS = "array<struct<s:int,e:int>>"


#: POSIX classes and long names of categories, and what Java calls them.
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\p{Space}", "upper": r"\p{Upper}", "word": r"\w", "xdigit": r"\p{XDigit}",
}
CATEGORIES = {"letter": "L", "lowercase_letter": "Ll", "uppercase_letter": "Lu", "mark": "M", "number": "N", "decimal_number": "Nd", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C"}


def _property(name: str) -> str:
    """A property in braces as Java calls it: short categories and Java's own names stay, scripts and long properties get Is."""
    plain = name.removeprefix("^")
    if plain.lower() in CATEGORIES:
        plain = CATEGORIES[plain.lower()]
    elif len(plain) > 2 and f"\\p{{{plain}}}" not in POSIX.values() and not plain.startswith(("Is", "In", "java")) and "=" not in plain:
        plain = "Is" + plain
    return plain


def _class(pattern: str, at: int) -> tuple[str, int]:
    """(Java's class, place after it) of the bracketed class that begins at a place; differences become intersections with a complement."""
    out, i = ["["], at + 1
    if pattern.startswith("^", i):
        out.append("^")
        i += 1
    first, negated, taken = True, out[-1] == "^", []
    while i < len(pattern):
        c = pattern[i]
        if c == "]" and not first:
            body = "".join(out[1 + negated :])
            for gone in taken:
                body = f"{body}&&[^{gone}]"
            return f"[^[{body}]]" if negated and taken else f"[{'^' * negated}{body}]", i + 1
        posix = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
        if posix:
            if posix[2] not in POSIX:
                raise ValueError(f"not a regular expression: no class {posix[2]!r} in {pattern!r}")
            name = POSIX[posix[2]]
            out.append((r"\W" if name == r"\w" else name.replace("p", "P", 1)) if posix[1] else name)
            i += len(posix[0])
        elif c == "[":
            inner, i = _class(pattern, i)
            out.append(inner)
        elif c == "\\":
            piece, i = _escape(pattern, i)
            out.append(piece)
        elif pattern.startswith("--", i) and not first and pattern[i + 2 : i + 3] == "[":
            inner, i = _class(pattern, i + 2)
            taken.append(inner)
        elif pattern.startswith("~~", i):
            raise ValueError(f"not a regular expression that can be told to Java: ~~ in {pattern!r}")
        else:
            out.append("\\]" if c == "]" else c)
            i += 1
        first = False
    raise ValueError(f"not a regular expression: a class without end in {pattern!r}")


def _escape(pattern: str, at: int) -> tuple[str, int]:
    """(Java's escape, place after it) of what begins with a backslash."""
    named = re.match(r"\\([pP])\{([^}]*)\}", pattern[at:])
    if named:
        turned = named[2].startswith("^")
        letter = {"p": "P", "P": "p"}[named[1]] if turned else named[1]
        return f"\\{letter}{{{_property(named[2])}}}", at + len(named[0])
    wide = re.match(r"\\[uU]\{([0-9A-Fa-f]+)\}", pattern[at:])
    if wide:
        return f"\\x{{{wide[1]}}}", at + len(wide[0])
    if pattern.startswith("\\Q", at):  # all up to \\E is literal
        end = pattern.find("\\E", at)
        end = len(pattern) if end < 0 else end + 2
        return pattern[at:end], end
    return pattern[at : at + 2], at + 2


@lru_cache(maxsize=4096)
def _translated(pattern: str) -> str:
    out, i, names = [], 0, {}
    while i < len(pattern):
        c = pattern[i]
        group = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
        back = re.match(r"\(\?P=(\w+)\)|\\k<(\w+)>", pattern[i:])
        flags = re.match(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]+))?[:)]", pattern[i:])
        if group:
            if group[1] in names:
                raise ValueError(f"not a regular expression: two groups are named {group[1]!r} in {pattern!r}")
            names[group[1]] = f"g{len(names)}"
            out.append(f"(?<{names[group[1]]}>")
            i += len(group[0])
        elif back and (back[1] or back[2]) in names:
            out.append(f"\\k<{names[back[1] or back[2]]}>")
            i += len(back[0])
        elif flags and "U" in flags[1] + (flags[2] or ""):
            raise ValueError(f"not a regular expression that can be told to Java: the flag U in {pattern!r}")
        elif c == "[":
            piece, i = _class(pattern, i)
            out.append(piece)
        elif c == "\\":
            piece, i = _escape(pattern, i)
            out.append(piece)
        else:
            out.append(c)
            i += 1
    return "".join(out)


def java_pattern(pattern: str, unicode: bool = False) -> str:
    """The pattern as Java reads it; one that can't be told to Java or compiled raises ValueError.

    Named groups may be spelled either way and have any names; POSIX classes, differences of classes, long names of categories, scripts and \\u{...} are translated.
    Only a line feed is a line's end to `.`, `^` and `$`. unicode: \\d, \\w, \\s and \\b by Unicode.
    """
    java = ("(?dU)" if unicode else "(?d)") + _translated(pattern)
    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except (Py4JJavaError, IllegalArgumentException) as e:  # the second once a session has replaced py4j's errors
            raise ValueError(f"not a regular expression: {pattern!r}: {e.java_exception.getMessage() if isinstance(e, Py4JJavaError) else e}") from None
    return java


def running(steps: Column, chunk: int = 64) -> Column:
    """The sum up to and with each of an array of ints, chunk by chunk: a list that grows step by step is only ever short."""
    grown = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    within = lambda part: F.aggregate(part, begin, grown, lambda acc: acc["out"])
    moved = lambda acc, part: F.struct(
        (acc["at"] + F.element_at(part, -1)).alias("at"), F.concat(acc["out"], F.array(F.transform(part, lambda x: x + acc["at"]))).alias("out")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))

    def sums(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / chunk).cast("int") - 1), lambda c: within(F.slice(s, c * chunk + 1, F.lit(chunk))))
        return F.when(F.size(s) > 0, F.flatten(F.aggregate(parts, start, moved, lambda acc: acc["out"]))).otherwise(F.array().cast("array<int>"))

    return let(steps, sums)


def find_spans(text: Column, pattern: str, unit: str = "bytes") -> Column:
    """[s, e) of every match in order, in bytes or chars, matches of the empty string too.

    The pieces between the matches (split) and the matches themselves (regexp_extract_all) alternate; running sums of their sizes
    are the places. What matches the empty string at the very start has no piece before it, which one piece too few tells.
    """
    size = F.octet_length if unit == "bytes" else F.char_length
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def spans(gaps: Column, hits: Column) -> Column:
        whole = F.when(F.size(gaps) <= F.size(hits), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps)
        steps = F.zip_with(F.slice(whole, 1, F.size(hits)), hits, lambda g, h: size(g) + size(h))
        return F.zip_with(running(steps), hits, lambda e, h: F.struct((e - size(h)).alias("s"), e.alias("e")))

    out = let(between, lambda gaps: let(found, lambda hits: spans(gaps, hits)))
    return F.when(text.isNotNull(), out).cast(SPANS)


def quote(literal: str) -> str:
    """A pattern that matches the literal text."""
    return "".join("\\" + c if c in r".+*?[](){}\^$|/-" else c for c in literal)


def resolve_overlaps(spans: Column) -> Column:
    """Spans sorted by start, each kept unless it starts inside the one kept before; equal starts stay in order."""
    def step(acc: Column, o: Column) -> Column:
        fits = o["s"] >= acc["at"]
        return F.struct(F.when(fits, o["x"]["e"]).otherwise(acc["at"]).alias("at"), F.when(fits, F.concat(acc["out"], F.array(o["x"]))).otherwise(acc["out"]).alias("out"))

    def kept(found: Column) -> Column:
        order = F.transform(found, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x.alias("x")))
        return F.aggregate(F.array_sort(order), F.struct(F.lit(0).alias("at"), F.slice(found, 1, 0).alias("out")), step, lambda acc: acc["out"])

    return let(spans, kept)
