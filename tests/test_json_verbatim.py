"""Values of JSON lines as they are written, against a plain reader."""

import random

import pytest

from sparklines.formats import parse
from sparklines.formats.json import verbatim_entries
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def plain(line):
    """Entries by walking over the characters; None for a line without any."""
    if not line.startswith("{"):
        return None
    out, i, n = [], 1, len(line)

    def text(i):
        while i < n and line[i] != '"':
            i += 2 if line[i] == "\\" else 1
        return i if i < n else None

    while True:
        while i < n and line[i] in BLANK:
            i += 1
        if i >= n or line[i] == "}":
            return out or None
        if line[i] != '"' or (end := text(i + 1)) is None:
            return None
        key, i = line[i + 1 : end], end + 1
        while i < n and line[i] in BLANK:
            i += 1
        if i >= n or line[i] != ":":
            return None
        i += 1
        while i < n and line[i] in BLANK:
            i += 1
        if i >= n:
            return None
        begin = i
        if line[i] == '"':
            if (end := text(i + 1)) is None:
                return None
            out.append((key, line[i + 1 : end], True))
            i = end + 1
        elif line[i] in "{[":
            left, right, depth = line[i], {"{": "}", "[": "]"}[line[i]], 0
            while i < n:
                c = line[i]
                i += 1
                if c == '"':
                    end = text(i)
                    i = n if end is None else end + 1
                depth += (c == left) - (c == right)
                if not depth:
                    break
            out.append((key, line[begin:i], False))
        else:
            while i < n and line[i] not in ",}]" + BLANK:
                i += 1
            out.append((key, line[begin:i], False))
        while i < n and line[i] in BLANK:
            i += 1
        if i < n and line[i] == ",":
            i += 1


def read(spark, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, raw string")
    got = df.select("i", verbatim_entries(F.col("raw")).alias("e")).collect()
    return {r.i: None if r.e is None else [tuple(x) for x in r.e] for r in got}


def test_entries_of_any_line(spark):
    rng = random.Random(7)

    def value(depth):
        k = rng.randrange(7 if depth else 4)
        if k < 2:
            return rng.choice(["1.50", "true", "null", "-2e+05", "007", ""])
        if k < 4:
            return '"' + "".join(rng.choice(["a", " ", "é", "\\\"", "\\\\", "\\n", "{", "}", "[", ",", ":"]) for _ in range(rng.randrange(6))) + '"'
        inner = [value(depth - 1) for _ in range(rng.randrange(3))]
        if k == 4:
            return "[" + ",".join(inner) + "]"
        return "{" + rng.choice([",", ", ", " "]).join(f'"k{j}":{v}' for j, v in enumerate(inner)) + "}"

    lines = ["", "{", "{}", "{ }", "[1]", ' {"a":1}', '{"a"}', '{"a":', '{"a": ', '{"a":}', '{"a":1]', '{"a":1,,"b":2}', '{,"a":1}', '{"a":1}x"b":2', '{"a":{"b":[}]}}', '{"a":"x', '{"a\\":1}', '{"a":[1,{"b":2', '{"a":"\\']
    for _ in range(400):
        keys = [rng.choice(["a", "b", "msg", "k\\\"q"]) for _ in range(rng.randrange(4))]
        line = "{" + rng.choice(["", " "]) + rng.choice([",", ", ", " ", " , "]).join(f'"{k}"{rng.choice(["", " "])}:{rng.choice(["", " "])}{value(3)}' for k in keys) + rng.choice(["}", "", " }", "} tail"])
        lines.append(line[: rng.randrange(len(line) + 1)] if rng.random() < 0.3 else line)
    assert read(spark, lines) == {i: plain(x) for i, x in enumerate(lines)}


def test_long_lines_and_deep_values(spark):
    long_ = '{"msg":"' + "x\\\"" * 900 + '","list":[' + ",".join(["1.0"] * 50_000) + "]}"
    many = '{"a":1.50,"l":[' + ",".join(['"s"'] * 20_000) + "]}"
    deep = '{"a":' + "[" * 10 + "]" * 10 + "}"
    got = read(spark, [long_, many, deep])
    assert got[0] == plain(long_) and got[2] == plain(deep)
    assert [e[0] for e in got[1]] == ["a", "l"]  # Spark's reading


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ('{"ts":"t","level":"INFO" "msg":"a\\tb","n":1.50,"n":2', ("t", "INFO", None, None, [("n", "1.50"), ("n", "2")], "a\\tb")),
        ('{"time":1,"timestamp":2,"fields":{"message":"in","time":9,"x":{"y":[1, 2]}},"msg":"out"}', ("1", None, None, None, [("time", "9"), ("x", '{"y":[1, 2]}')], "in")),
        ('{"span":{"name":"s","id":01,"name":"t"},"spans":[1],"fields":7,"target":"a","module":"b"}', (None, None, "a", ("t", [("id", "01")]), [], None)),
        ('{"fields":"{\\"a\\":1}","span":"x"}', (None, None, None, None, [("fields", '{\\"a\\":1}'), ("span", "x")], None)),
        ("plain", None),
    ],
)
def test_slots(spark, line, want):
    r = spark.createDataFrame([(line,)], "raw string").select(parse(F.col("raw"), "json_verbatim").alias("p")).first().p
    got = None if r is None else (r.timestamp, r.level, r.target, None if r.span is None else (r.span.name, [tuple(x) for x in r.span.fields]), [tuple(x) for x in r.extra], r.message)
    assert got == want
