"""Collocations, nearest neighbours and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparklines.llm import collocations as C
from sparklines.llm.collocations import collocations, count_phrases
from sparklines.llm.neighbours import SortedArrays, misses_allowed, nearest
from sparklines.llm.periodic_runs import _plain_scan, find_runs, runs_of, split_rare

DOCS = "doc_id long, text string, lang string, words int, n long, slot long, shard int, start long"
EXTRA = (1, 2, 3, 4, 5)

# ---- collocations


def brute_phrases(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    return f, n


def brute_collocations(rows, least=10, top=2000):
    f, n = brute_phrases(rows)
    out = []
    some = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, p), a in some.items():
        if len(p) == 3:
            for sub in (p[:2], p[1:]):
                longer[lang, sub] = max(longer[lang, sub], a)
    for lang in n:
        found = []
        for (of, p), a in some.items():
            if of == lang and 100 * longer[lang, p] < 50 * a:
                score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def prose(rng, n, size):
    words = ["aLpha", "béta", "ga\u0085mma", "Δelta", "a\x1cb"] + [f"w{i}" for i in range(size)]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\x0b", "\r\n", " ? "]) for _ in range(n))


@pytest.mark.parametrize(("shards", "slots"), [(1, 1 << 16), (3, 1 << 16), (5, 4)])
def test_collocations(spark, shards, slots):
    rng = random.Random(shards)
    rows = [(i, prose(rng, rng.randrange(400), 12), rng.choice(["en", "en", "fr", None, "und"])) for i in range(40)]
    rows += [(100, None, "en"), (101, "", None), (None, "lone words here", "xx"), (3, rows[3][1], "en"), (3, rows[3][1], "en"), (102, " \t ", "yy")]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)
    got = collocations(df, top=25, shards=shards, slots=slots)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, top=25)


def test_phrases_that_become_frequent_late_are_counted_whole(spark):
    rows = [(i, "x y z. " * (1 if i < 30 else 9), "en") for i in range(40)]
    frequent, totals = count_phrases(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS), shards=7, slots=1 << 10)
    f, n = brute_phrases(rows)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in frequent.collect()} == {k: v for k, v in f.items() if v >= 10}
    assert [tuple(r) for r in totals.collect()] == [("en", n["en"])]


def test_counts_beyond_64_bits_and_other_lengths(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, prose(rng, 300, 3), "en") for i in range(12)]
    monkeypatch.setattr(C, "CHUNK", 500)
    frequent, _ = count_phrases(spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS), longest=4, shards=2, slots=1 << 12)
    got = {tuple(r.phrase.split(" ")): r.n for r in frequent.collect() if r.words < 4}
    assert got == {p: a for (_, p), a in brute_phrases(rows)[0].items() if a >= 10}
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long").selectExpr(
        "cast(a as decimal(20,0)) * cast(a as decimal(20,0)) * 1000000 as up", "cast(l as decimal(20,0)) * cast(r as decimal(20,0)) as down"
    )
    assert df.selectExpr("up div down as s").first().s == 10**6 * big * big // ((big + 1) * (big + 2))


def test_no_documents_no_collocations(spark):
    assert collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations(spark.createDataFrame([(1, "once only", None, *EXTRA)], DOCS)).count() == 0


# ---- nearest neighbours

VECTORS = "vec_id long, embedding array<float>, label int, part int, block int, rank int, score double"


def brute_nearest(rows, k, every):
    x = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in x:
        if q % every == 0:
            s = sorted(((-float((v * x[q]).sum()), i) for i, v in x.items() if i != q and len(v) == len(x[q])))
            out[q] = s[:k]
    return out


@pytest.mark.parametrize(("n", "dim", "kind"), [(300, 16, "unit"), (3000, 64, "unit"), (3000, 32, "norms"), (2000, 48, "groups"), (25, 8, "unit")])
def test_recall_of_neighbours(spark, n, dim, kind):
    rng = np.random.default_rng(n + dim)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    if kind == "groups":
        x += 2 * rng.standard_normal((10, dim)).astype(np.float32)[rng.integers(10, size=n)]
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x *= np.exp(rng.standard_normal((n, 1))).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(i, v, 1, 1, 1, 1, 1.0) for i, v in rows], VECTORS)
    got = defaultdict(list)
    for r in nearest(df, shard=1000, together=40).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(want[q]) + 1))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        for _, i, s in found:
            assert s == pytest.approx(float((x[i].astype(float) * x[q].astype(float)).sum()), abs=1e-12)
        hits += len({i for _, i in want[q]} & {i for _, i, _ in found})
        total += len(want[q])
    assert hits / total >= 0.95


def test_neighbours_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [1.0, None]), (100, []), (120, [inf, 0.0])]
    rows += [(140, [1.0, 2.0, 3.0]), (141, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (160, [-1.0, 0.0]), (160, [-2.0, 0.0]), (-20, [3.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1.0) for r in rows], VECTORS)
    got = defaultdict(list)
    for r in nearest(df, k=3).orderBy("query_id", "rank", "vec_id").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got[0] == [(-20, 3.0), (1, 1.0), (2, 1.0)]
    assert got[140] == [(141, 1.0)]
    assert got[-20] == [(0, 3.0), (1, 3.0), (2, 3.0)]
    assert sorted(got[160])[-2:] == [(160, 2.0), (160, 2.0)] and len(got[160]) == 6  # two rows, each the other's candidate
    assert set(got) == {0, 140, 160, -20}
    assert nearest(df.filter("vec_id = 3")).count() == 0 == nearest(df.limit(0)).count()
    tiny = spark.createDataFrame([(i, [1e-30 * (i + 1), 1e-30], 1, 1, 1, 1, 1.0) for i in range(50)], VECTORS)
    assert [r.vec_id for r in nearest(tiny, k=2, every=50).orderBy("rank").collect()] == [49, 48]


def test_copies_of_a_vector_rank_by_id(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.6, 0.8, 0.0] if i % 3 else [float(v) for v in rng.standard_normal(3) * 0.3]) for i in range(900)]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1, 1.0) for r in rows], VECTORS)
    want = brute_nearest(rows, 20, 20)
    got = defaultdict(list)
    for r in nearest(df, shard=300).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    copies = [q for q in want if q % 3]
    assert all(got[q] == [i for _, i in want[q]] for q in copies)


def test_windows_count_as_defined():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 6))
    a = SortedArrays(x, np.arange(500), np.arange(500), 1.0, float(np.linalg.norm(x, axis=1).max()), 10, 3)
    centres, radius = rng.standard_normal((4, 10)), np.array([0.1, 0.5, 1.0, 2.5])
    at = np.empty((10, 500))
    np.put_along_axis(at, np.argsort(a.places, axis=1), a.values, axis=1)
    want = (np.abs(at[None] - centres[:, :, None]) > 2.0 * radius[:, None, None]).sum(axis=1)
    assert (a.outside(centres, radius) == want).all()
    assert misses_allowed(96, 0.5) < misses_allowed(96, 0.01) < 96


# ---- periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planted):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = (None,) * 4
    for a, m, q in runs:
        if best[0] is None or m * best[2] > best[1] * q:
            best = (a, m, q, 1000 * m // q)
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_documents(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) + rng.choice(["", "", " x", "é"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words) + 1), rng.randrange(1, 9)
            words[at:at] = words[at : at + p] * rng.randrange(2, 7)
        rows.append((rng.choice([None, i, i, 7]), rng.choice([" ", "\t", "\r\n"]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a " * 5), (1004, "a " * 6), (1005, "a b " * 4), (1006, "a b " * 3 + "a"), (1007, "x " * 30_000), (-4, "p q r " * 5)]
    df = spark.createDataFrame([(i, t, "en", *EXTRA) for i, t in rows], DOCS).repartition(2)
    key = lambda r: repr(r)
    for planted in (False, True):
        want = sorted((brute_row(i, t, planted) for i, t in rows if len(t or "") < 10_000), key=key)
        got = [tuple(r) for r in find_runs(df, planted=planted).collect()]
        assert sorted((r for r in got if r[0] != 1007), key=key) == want
        assert next(r for r in got if r[0] == 1007)[1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert find_runs(df.limit(0)).count() == 0


def test_scan_of_long_lags_and_splitting(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr("sparklines.llm.periodic_runs.SHORT_LAGS", 3)
    for _ in range(300):
        w = [rng.randrange(40) for _ in range(rng.randrange(1, 200))]
        at, p = rng.randrange(len(w)), rng.randrange(1, 30)
        w[at:at] = w[at : at + p] * rng.randrange(3, 7)
        ids = np.array(w)
        assert runs_of(ids, np.zeros(len(w), int)) == brute_runs(w) == _plain_scan(ids, len(w))
    at, seg = split_rare(np.array([1, 2, 1, 2, 1, 2, 1, 2, 9, 1, 1, 1, 1, 1, 3, 3, 3]), np.zeros(17, int))
    assert at.tolist() == list(range(8)) and len(set(seg.tolist())) == 1  # five 1s are too short for a run, 3 and 9 too rare


def test_runs_of_very_long_texts():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1000, 400_000)
    w[100_000:300_000] = np.tile(rng.integers(0, 100_000, 40_000), 5)
    assert [r for r in runs_of(w, np.zeros(len(w), int)) if r[1] > 1000] == [(100_000, 200_000, 40_000)]


# ---- repeated ids and many vectors of near-duplicate vectors


def test_ids_in_several_classes_are_one_node(spark):
    from sparklines.llm.embedding_dedup import link_embeddings

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, a), (9, a), (7, b), (9, b), (8, c), (20, c), (20, None), (21, c)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_embeddings(df).collect())
    assert got == [(5, 1, 5, True), (7, 1, 5, False), (8, 2, 8, True), (9, 2, 5, False), (9, 2, 5, False), (20, 0, 20, True), (20, 2, 8, False), (21, 2, 8, False)]


def test_the_bound_of_a_cap_needs_little_memory_and_holds():
    import tracemalloc

    from sparklines.llm.embedding_dedup import cap_bound, code_words, directions

    tracemalloc.start()
    alpha = cap_bound(64, 2, 20_000, 11, 9, 0.93)  # words for some 10^8 vectors of a label
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    words, rng = code_words(64, 2, 20_000, 11), np.random.default_rng(8)
    x, y = rng.standard_normal((2, 200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    (i, p), (j, q) = directions(x, words, alpha, 10), directions(y, words, alpha, 10)
    met = {(a, b) for a, b in zip(i.tolist(), p.tolist(), strict=True)} & {(a, b) for a, b in zip(j.tolist(), q.tolist(), strict=True)}
    assert len({a for a, _ in met}) >= 180  # of 200 pairs at the threshold
