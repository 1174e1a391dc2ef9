"""Patterns as users write them, told to Java."""

import pytest
from pyspark.sql import functions as F

from sparklines.functions.spans import java_pattern
from sparklines.model import filter_set
from sparklines.operators.visibility import visible_lines

CASES = [
    (r"(?P<user_id>\d+) of (?<_b>\w+)", ["7 of x"], ["x of 7"]),
    (r"(?P<a_b>ab)-(?P=a_b)", ["ab-ab"], ["ab-a"]),
    (r"(?<q_1>ab)-\k<q_1>", ["ab-ab"], ["ab-a"]),
    (r"^[[:alpha:]]+$", ["abcXYZ"], ["abc1", ":alph1", ""]),
    (r"^[[:^digit:]_]+$", ["ab_"], ["a1"]),
    (r"^[^[:space:][:punct:]]+$", ["ab1"], ["a b", "a,b"]),
    (r"^[x[:word:]-]+$", ["a_1-x"], ["a b"]),
    (r"^[a-z--[aeiou]]+$", ["xyz"], ["xaz", "XYZ"]),
    (r"^[^a-z--[aeiou]]+$", ["aeX1"], ["xyz", "aeb"]),
    (r"^[a-z&&[^aeiou]]+$", ["xyz"], ["xaz"]),
    (r"^[]a]+$", ["]a]"], ["b"]),
    (r"^[\]\-[x-z]]+$", ["]-xy"], ["a"]),
    (r"^\p{Greek}+ \p{Letter}\p{Lowercase_Letter}$", ["αβγ Ab"], ["abc Ab"]),
    (r"^\p{^Lu}\P{^Lu}$", ["aB"], ["Ba"]),
    (r"^[\p{Cyrillic}\p{Alpha}]+$", ["жabc"], ["γ"]),
    (r"^\u{1F600}\x{41}$", ["\U0001f600A"], ["A"]),
    ("^a.b$", ["a\u0085b", "a b", "a\rb"], ["a\nb"]),
    ("b$", ["ab"], ["b ", "b\u0085"]),
    (r"\Q(?P<x_y>[[:\E+", ["(?P<x_y>[[:[["], ["x"]),
    (r"(?i:AB)(?-i)c", ["abc"], ["abC"]),
]


@pytest.mark.parametrize(("pattern", "good", "bad"), CASES)
def test_read_as_meant(spark, pattern, good, bad):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(good + bad)], "id int, raw string").withColumn("src", F.lit("s")).withColumn("line_idx", F.col("id").cast("long"))
    want = set(range(len(good)))
    assert {r.id for r in df.filter(F.rlike("raw", F.lit(java_pattern(pattern)))).collect()} == want
    assert {r.id for r in visible_lines(df, filter_set(("Include", pattern))).collect()} == want


@pytest.mark.parametrize("pattern", ["[[:nothing:]]", "[a-z~~[c]]", "(?U)a+", "(?i-U:a)", "(?P<a>x)(?P<a>y)", "[abc", "a(", r"\p{Nonsense}", "(?P<1a>x)"])
def test_refused_rather_than_misread(spark, pattern):
    with pytest.raises(ValueError, match="not a regular expression"):
        java_pattern(pattern)


def test_unicode_switch(spark):
    df = spark.createDataFrame([("é٣",)], "raw string")
    assert df.filter(F.rlike("raw", F.lit(java_pattern(r"^\w\d$", unicode=True)))).count() == 1
    assert df.filter(F.rlike("raw", F.lit(java_pattern(r"^\w\d$")))).count() == 0
