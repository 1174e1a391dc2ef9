"""What moves: texts are shuffled once at most, and rows that no step asks for stay where they are."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparklines.llm import paragraph_dedup
from sparklines.llm.common import parted
from sparklines.llm.exact_dedup import kept_rows
from sparklines.llm.similar_texts import similar_texts
from sparklines.shared import checkpoint_root, hadoop

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def held(spark, tag):
    """Tables of that tag in the shared folder."""
    p, fs = hadoop(spark, f"{checkpoint_root(spark)}/sparklines/{tag}-*")
    return len(fs.globStatus(p) or [])


@pytest.mark.parametrize("hot", [1024, 7])
def test_kept_rows_need_no_index(spark, hot):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "é", "b " * 400, *(f"t{k}" for k in range(30))]), "en", None, i) for i in range(400)]
    rows += [(None, "alone", "de", None, 1), (None, "alone", "de", None, 1), (7, "twice", "en", "s", 2), (7, "twice", "en", "s", 2)]
    before = held(spark, "index")
    got = kept_rows(spark.createDataFrame(rows, DOCS), corpus_pipeline.COLUMNS, hot=hot)
    assert got.columns == corpus_pipeline.COLUMNS
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r)
    want = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert held(spark, "index") == before


@pytest.mark.parametrize("most", [1 << 15, 1 << 25])
def test_parted_rows_are_whole_and_miss_no_id(spark, most):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20_000)] + [(None, "none")], "doc_id long, text string")
    ids = df.filter("doc_id % 10 = 3").select("doc_id")
    some, rest = parted(df, "doc_id", ids, 2000, most)
    inside = {r.doc_id for r in some.collect()}
    outside = {r.doc_id for r in rest.collect()}
    assert inside | outside == {*range(20_000), None} and not inside & outside
    assert {i for i in range(20_000) if i % 10 == 3} <= inside and len(inside) < 3500
    for part in (some, rest):
        assert "Exchange hashpartitioning" not in part._jdf.queryExecution().executedPlan().toString()


def test_near_moves_the_texts_of_candidates_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(2)
        rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "en", "a", 1) for i in range(500)]
        docs = spark.createDataFrame([*rows, *((1000 + i, t, "en", "a", 1) for i, t, *_ in rows[:5])], DOCS)
        tables = {t: held(spark, t) for t in ("signed", "asked", "shingles", "links")}
        got = corpus_pipeline.near(spark, docs, "")
        assert {r.doc_id for r in got.collect()} == set(range(500))
        # the rows that no link names come by a scan of their own, without an exchange
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LeftAnti") == 2 and plan.count("LeftSemi") == 1
        assert {t: held(spark, t) for t in tables} == tables
        assert similar_texts(docs).filter(F.col("a") == F.col("b")).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_growth_counts_no_step_whose_words_differ(monkeypatch):
    rng = random.Random(4)
    other = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    passage = other(60)
    texts = [" ".join([*other(40), *passage[:30], "\nchanged", *passage[31:], *other(40)]), " ".join([*other(70), *passage, *other(70)])]
    place = [(t.index(passage[5]), t.index(passage[15])) for t in texts]
    seeds = [{"start": place[1][0], "end": place[1][1] - 1, "k_start": place[0][0], "k_end": place[0][1] - 1}]
    none = {k: None for k in ("doc_id", "k_rid", "k_doc", "n", "seeds")}
    asks = [[none | {"kid": 1, "lo": place[0][0], "hi": place[0][1] - 1}], [{"kid": 1, "lo": place[1][0], "hi": place[1][1] - 1, "doc_id": 9, "k_rid": 10, "k_doc": 3, "n": 2, "seeds": seeds}], []]
    longs = {k: pa.int64() for k in ("kid", "doc_id", "k_rid", "k_doc", "n")}
    kind = [("kid", longs["kid"]), ("lo", pa.int32()), ("hi", pa.int32()), *[(k, pa.int64()) for k in ("doc_id", "k_rid", "k_doc", "n")], ("seeds", pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "end", "k_start", "k_end")])))]
    batch = pa.RecordBatch.from_arrays([pa.array([10, 11, 12], pa.int64()), pa.array([*texts, ""]), pa.array(asks, pa.list_(pa.struct(kind)))], names=["rid", "text", "asks"])
    windows = pa.Table.from_batches(paragraph_dedup._windows(48)(iter([batch])))
    assert windows.column("rid").to_pylist() == [10, 11] and windows.column("ask").to_pylist() == [asks[0][0], asks[1][0]]
    asked, kept = windows.slice(1, 1), windows.slice(0, 1)
    for c in ("w", "s", "e", "breaks", "line"):
        asked = asked.append_column("k_" + c, kept.column(c))
    calls, same = [], paragraph_dedup._same
    monkeypatch.setattr(paragraph_dedup, "_same", lambda *a: calls.append(1) or same(*a))
    got = pa.Table.from_batches(paragraph_dedup._grow(5, 0.8, 20)(iter(asked.combine_chunks().to_batches()))).to_pylist()
    assert len(calls) <= 4  # both ways from the seed and the step over the changed word
    mine, other_ = texts[1], texts[0]
    (row,) = got
    assert mine[row["start"] : row["end"]] == " ".join(passage) and row["n_words"] == 60 and row["paragraph"] == 0
    assert other_[row["k_start"] : row["k_end"]].split() == [*passage[:30], "changed", *passage[31:]] and row["k_words"] == 60 and row["k_paragraph"] == 0
    assert (row["rid"], row["doc_id"], row["k_rid"], row["k_doc"], row["n"]) == (11, 9, 10, 3, 2)
