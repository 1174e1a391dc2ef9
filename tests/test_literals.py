"""The index of grams gives the rows of plain substring searches."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparklines.functions.literals import GramIndex
from sparklines.operators.visibility import match_any_literal


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_matches_of_any_size(kind):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcé\n ") for _ in range(n))
    for _ in range(200):
        literals = [text(rng.choice([1, 2, 3, 4, 5, 9, 20])) for _ in range(rng.randrange(1, 30))]
        literals = rng.sample(literals, max(1, len(literals) // 2))
        lines = [None if rng.random() < 0.05 else text(rng.choice([0, 1, 3, 8, 40])) for _ in range(40)]
        lines[0] = "xx" + literals[0] + "xx"
        index, array = GramIndex(literals), pa.array(lines, kind)
        want = [None if x is None else any(lit in x for lit in literals) for x in lines]
        assert index.match(array).to_pylist() == want
        assert index.match(array.slice(3, 20)).to_pylist() == want[3:23]  # a part, with what the first lines have chosen
    assert GramIndex(["", "a"]).match(pa.array(["b", "", None])).to_pylist() == [True, True, None]
    assert GramIndex(["a"]).match(pa.array([], pa.string())).to_pylist() == []


def test_no_match_reaches_over_the_end_of_a_line():
    assert GramIndex(["abcdef", "cd", "d"]).match(pa.array(["abc", "def", "ab", "c", "xd"])).to_pylist() == [False, True, False, False, True]


def test_thousands_cost_little_more_than_few(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(15))) for i in range(20_000)], "id long, raw string").repartition(4).cache()
    df.count()
    few, many = [f"no{i}such" for i in range(38)] + words[:2], [f"no{i}such" for i in range(4998)] + words[:2]
    got = {}
    for name, literals in (("few", few), ("many", many)):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            got[name] = df.filter(match_any_literal(F.col("raw"), literals)).count()
            took.append(time.perf_counter() - began)
        got[name + "_s"] = min(took)
    assert got["few"] == got["many"] == df.filter(F.contains("raw", F.lit(words[0])) | F.contains("raw", F.lit(words[1]))).count() > 0
    print(got)
    assert got["many_s"] < 10 * got["few_s"] + 2  # a bound that holds on a busy machine; README.md has measured figures
