"""The pipeline against a plain rendering of its stages, and each stage on awkward tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from sparklines.llm.common import block_pairs
from sparklines.llm.queries import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, _p string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), None, "x", "y") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = {"en": "the of and to in is that it was for on are".split(), "de": "der die und zu den das nicht von sie ist des sich".split()}
    out = []
    for i in range(160):
        lang = sorted(vocab)[i % 2]
        out.append((i, " ".join(rng.choice(vocab[lang]) + rng.choice(["", "", "e", "n"]) for _ in range(rng.randrange(40, 80))), lang, rng.choice(["a", "b", "c", None])))
    out += [(200 + i, out[i][1], out[i][2], out[i][3]) for i in range(30)]
    out += [(300 + i, out[i][1] + "  ", out[i][2], "c") for i in range(10)]
    return out + [(400, None, "en", "a"), (401, "", None, "b"), (402, "123 ...", "de", None), (403, "the of and", None, "a"), (403, "the of and", None, "a")]


def near_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", text.lower())
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_stages_against_plain_python(spark, rows, tmp_path):
    docs = table(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        left[name] = [tuple(r) for r in docs.collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert Counter(r[0] for r in left["language"]) == Counter(i for i, t, *_ in rows if t and re.search("[a-z]", t))
    groups = defaultdict(list)
    for r in left["language"]:
        groups[r[1]].append(r[0])
    assert sorted(r[0] for r in left["exact"]) == sorted(max(g) for g in groups.values())
    prints = {r[0]: near_fingerprint(r[1]) for r in left["exact"]}
    root = {i: i for i in prints}
    for _ in prints:
        again = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if again == root:
            break
        root = again
    assert sorted(r[0] for r in left["near"]) == sorted({root[i] for i in prints})
    times = Counter(r[0] for r in left["mix"])
    assert set(times) <= set(prints) and max(times.values()) <= 2
    assert Counter(r[0] for r in left["encode"]) == times
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(left["encode"], key=str)


def test_near_copies_beyond_three_bits_go(spark):
    rng = random.Random(3)
    texts = {}
    for i in range(30):
        w = [f"w{rng.randrange(3000)}" for _ in range(100)]
        texts[i] = " ".join(w)
        for k in range(1, 3):  # two words edited: Jaccard 0.81; six words edited: less than 0.6
            texts[100 * k + i] = " ".join("new" if j in ([30, 70] if k == 1 else [5, 20, 35, 50, 65, 80]) else x for j, x in enumerate(w))
    prints = {i: near_fingerprint(t) for i, t in texts.items()}
    assert sum((prints[i] ^ prints[100 + i]).bit_count() > 3 for i in range(30)) > 10
    left = corpus_pipeline.near(spark, table(spark, [(i, t, "en", "a") for i, t in texts.items()]), "").collect()
    assert {r.doc_id for r in left} == {i for i in texts if not 100 <= i < 200}


def test_near_copies_of_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    texts = {i: " ".join(f"new{i}" if j % 5000 == i else w for j, w in enumerate(words)) for i in range(4)} | {9: " ".join(reversed(words))}
    left = corpus_pipeline.near(spark, table(spark, [(i, t, "en", "a") for i, t in texts.items()]), "").collect()
    assert sorted(r.doc_id for r in left) == [0, 9]


def test_blocks_by_rows_and_by_bytes(spark):
    rows = spark.range(200).selectExpr("id", "id % 2 as band", "if(id % 2 = 0, 1000, 10) as bytes")
    for cap, most, parts in ((500, 20_000, {0: 5, 1: 1}), (30, 10**9, {0: 4, 1: 4})):
        got = block_pairs(rows, "band", "id", cap, "bytes", most).collect()
        met = defaultdict(list)
        for r in got:
            assert r.side in (r.bi, r.bj) and 0 <= r.bi <= r.bj < parts[r.band]
            met[r.band, r.bi, r.bj].append(r)
        pairs = Counter((a.id, b.id) for g in met.values() for a in g for b in g if a.id < b.id and (g[0].bi == g[0].bj or a.side != b.side))
        assert set(pairs.values()) == {1} and len(pairs) == 2 * 100 * 99 // 2
        assert max(len(g) for k, g in met.items() if parts[k[0]] > 1) < 90


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, table(spark, []), "").collect() == []


def test_stages_on_rows_without_anything(spark):
    docs = table(spark, [(None, None, None, None), (None, None, None, None), (1, "", None, None)])
    assert dict(corpus_pipeline.STAGES)["language"](spark, docs, "").collect() == []
    assert len(dict(corpus_pipeline.STAGES)["exact"](spark, docs, "").collect()) == 1
    assert len(dict(corpus_pipeline.STAGES)["near"](spark, docs, "").collect()) == 3
    assert len(dict(corpus_pipeline.STAGES)["mix"](spark, docs, "").collect()) == 3
    assert len(dict(corpus_pipeline.STAGES)["encode"](spark, docs, "").collect()) == 3


def test_every_operator_is_registered_once():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
