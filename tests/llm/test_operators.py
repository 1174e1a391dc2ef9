"""Each operator on small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import os
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparklines.llm.common import block_pairs, map_groups
from sparklines.llm.components import connected_components
from sparklines.llm.embedding_dedup import link_embeddings
from sparklines.llm.exact_dedup import build_directory, exact_dedup
from sparklines.llm.langid import counts, identify_languages
from sparklines.llm.mixing import mix_sources
from sparklines.llm.paragraph_dedup import repeated_paragraphs
from sparklines.llm.pii import find_pii
from sparklines.llm.sentencepiece_codec import CharacterMap, PieceModel, encode_documents
from sparklines.llm.sharding import shard_documents
from sparklines.llm.simhash import VantageTree, fingerprint, link_near_texts, masks, near_pairs
from sparklines.llm.token_files import BLOCK, pack, read_token_files, unpack, write_token_files

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, kept boolean, salt int, h long, bucket int, component_id long"


def docs(spark, rows):
    """Documents with further columns that are named like the operators' own."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), True, 1, 2, 3, 4) for r in rows], DOCS)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def union_find(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


# ---- shared pieces


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 60
    edges = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)] + [(5, 5)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)], "empty": []}[shape]
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = union_find(n, edges)
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_blocks_bring_every_pair_together_once(spark):
    rows = [(1, i) for i in range(50)] + [(2, i) for i in range(3)]
    df = block_pairs(spark.createDataFrame(rows, "k long, id long"), "k", "id", 10)

    def pairs(t):
        import pyarrow as pa

        ids, side, across = t.column("id").to_pylist(), t.column("side").to_pylist(), t.column("bi")[0] != t.column("bj")[0]
        got = [(a, b) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b and (not across or side[i] != side[j])]
        k = t.column("k")[0].as_py()
        return pa.table({"k": [k] * len(got), "a": [g[0] for g in got], "b": [g[1] for g in got]}) if got else None

    got = Counter((r.k, r.a, r.b) for r in map_groups(df, ["k", "bi", "bj"], pairs, "k long, a long, b long").collect())
    assert got == Counter({(k, a, b): 1 for k, n in ((1, 50), (2, 3)) for a in range(n) for b in range(a + 1, n)})


# ---- op 1


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 32))
    x = np.concatenate([base, base[:40] + rng.standard_normal((40, 32)) * 0.25, base[:5]]).astype(np.float32)
    label = [int(i) % 3 for i in rng.integers(0, 3, len(x))]
    label[60:100] = label[:40]
    label[100:] = label[:5]
    rows = [(i, [float(v) for v in x[i]], label[i], 9) for i in range(len(x))]
    odd = [(200, None, 1, 9), (201, [0.0] * 32, 1, 9), (202, [float("nan")] + [1.0] * 31, 1, 9), (203, [None] + [1.0] * 31, 1, 9), (204, rows[0][1], None, 9), (205, [], 1, 9), (206, rows[0][1][:8], label[0], 9), (None, rows[0][1], label[0], 9)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_embeddings(df, cap=16).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(link, False)
    root = union_find(len(x), zip(*np.nonzero(link), strict=True))
    assert {i: got[i] for i in range(len(x))} == {i: (int(link[i].sum()), root[i], root[i] == i) for i in range(len(x))}
    assert link.sum() > 40
    assert all(got[i] == (0, i, True) for i in (200, 201, 202, 203, 204, 205, 206))
    assert got[None] == (0, None, True)


def test_embeddings_recall_on_near_pairs(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((300, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<float>, label int")
    assert link_embeddings(df).agg(F.sum("n_links")).first()[0] >= 0.99 * 600


@pytest.mark.parametrize("n", [500, 4000])
def test_embeddings_recall_follows_the_rows(spark, n):
    """More rows: more directions, as many shared by near pairs."""
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((n, 24))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.931 * a + np.sqrt(1 - 0.931**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>, label int")
    got = link_embeddings(df, bucket=8).agg(F.sum("n_links")).first()[0]
    x = np.concatenate([a, b])
    want = sum(int((x[k : k + 1000] @ x.T >= 0.93).sum()) for k in range(0, len(x), 1000)) - len(x)
    assert 0.99 * want <= got <= want


def test_embeddings_in_double_precision(spark):
    """A pair that only single precision would lift over the threshold, and rows that repeat an id with other vectors."""
    c = 0.93 - 1e-9
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [c, float(np.sqrt(1 - c * c)), 0.0], 0), (3, [0.0, 0.0, 1.0], 0), (3, [1.0, 0.0, 0.001], 0)]
    got = link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == Counter([(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (3, 1, 1, False)])


def test_embeddings_empty(spark):
    assert link_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


# ---- op 2

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn_ok(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(t - 9 * (t > 9) for t in twice) % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn_ok(d), "phone": 10 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_personal_data_against_regular_expressions(spark):
    rng = random.Random(1)
    fixed = [None, "", "a@b.c%d@e.f x é😀 a@b-c.d.e. 1.2.3.4.5.6.7.8 999.1.1.1 00255.1.2.3 +1 (555) 123-4567 4111 1111 1111 1111", "a@" * 3000, "1." * 9000, "a@b" + ".c" * 9000, "1 " * 9000]
    texts = fixed + ["".join(rng.choice("ab@.%+-_ 0123456789()é" if i % 2 else "0123456789.+ -@a") for _ in range(rng.randint(0, 250))) for i in range(400)]
    got = {r.doc_id: r for r in find_pii(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t)
        want = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[2] == k for s in spans) for k in PATTERNS]


def test_personal_data_scores(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "code 123-45-6789"]
    got = find_pii(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [[(p.k, p.s, p.e) for p in r.pii] for r in got] == [[("iban", 5, 32)], [], [("ssn", 4, 15)], []]
    assert got[0].pii[0].score == 1.0
    plan = find_pii(docs(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


KINDS_OF_TEXT = [
    ("AT61 1904 3002 3457 3201 BIC code", [("iban", 0, 24)]),
    ("pay BE68 5390 0754 7034 EUR 50", [("iban", 4, 23)]),
    ("BE68539007547034", [("iban", 0, 16)]),
    ("BE685390075470345", []),
    ("XBE68539007547034", []),
    ("GB82 WEST 1234 5698 7654 32.", [("iban", 0, 27)]),
    ("NO93 8601 1117 947 and MT84MALT011000012345MTLCAST001S", [("iban", 0, 18), ("iban", 23, 54)]),
    ("NO93 8601 1117 948", []),
    ("ZZ68 5390 0754 7034", []),
    ("serial BE68 5390 0754 7034", []),
    ("bank account, order 7: BE68 5390 0754 7034", [("iban", 23, 42)]),
    ("my ssn 123-45-67890", []),
    ("social 9123-45-6789", []),
    ("ssn 4-123-45-6789", []),
    ("ssn 123-45-6789-1", []),
    ("ssn: 123-45-6789.", [("ssn", 5, 16)]),
    ("ssn 000-45-6789 ssn 666-45-6789 ssn 912-45-6789 ssn 123-00-6789 ssn 123-45-0000", []),
    ("ssn of invoice 123-45-6789", []),
]


def test_personal_data_further_kinds(spark):
    got = find_pii(docs(spark, [(i, t) for i, (t, _) in enumerate(KINDS_OF_TEXT)])).orderBy("doc_id").collect()
    for row, (text, want) in zip(got, KINDS_OF_TEXT, strict=True):
        assert [(p.k, p.s, p.e) for p in row.pii if p.k in ("iban", "ssn")] == want, text


def test_personal_data_context_is_of_whole_words(spark):
    texts = ["the hotel antisocial club 123-45-6789", "his social number: 123-45-6789", "123-45-6789 (SSN)", "ssn " + "x " * 60 + "123-45-6789"]
    got = find_pii(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [len(r.pii) for r in got] == [0, 1, 1, 0]


def test_personal_data_in_empty_tables_and_repeated_rows(spark):
    assert find_pii(docs(spark, [])).collect() == []
    got = find_pii(docs(spark, [(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c")])).collect()
    assert [r.spans for r in got] == ["email:0:5"] * 3 and sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]


def test_personal_data_takes_time_linear_in_matches(spark):
    def took(n):
        text = "".join(f"from 10.0.{i % 256}.7 mail é{i}@example.org\n" for i in range(n))
        began = time.perf_counter()
        row = find_pii(docs(spark, [(1, text)])).first()
        assert row.n_ip == row.n_email == n
        return time.perf_counter() - began

    took(100)
    few, many = took(2000), took(16_000)
    assert many < 12 * max(few, 0.5)


# ---- op 3


def test_languages(spark):
    rng = random.Random(5)
    vocab = {"en": "the of and to in is that it was for on are".split(), "de": "der die und zu den das nicht von sie ist des sich".split(), "fr": "le de un à être et en avoir que pour dans ce".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(30)), lang) for i in range(240) for lang in [sorted(vocab)[i % 3]]]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !?", "fr"), (903, "der die das nicht " * 50_000, None), (None, "the of and to in is", None)]
    got = {r.doc_id: r for r in identify_languages(docs(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:240])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows if i is not None)
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert got[903].lang_pred == "de" and got[None].lang_pred == "en" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_reject_what_was_not_learned(spark):
    rng = random.Random(8)
    syllables = {"en": "the of and ing er th on at he re".split(), "es": "de la que os ar ió es ra lla ción".split()}

    def text(lang, n):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    def junk(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))

    rows = [(i, text(["en", "es"][i % 2], rng.randrange(3, 250)), ["en", "es"][i % 2]) for i in range(600)]
    kinds = ["".join(map(chr, range(0x4E00, 0x9000))), "".join(map(chr, range(0x430, 0x450))), "bcdfghjklmnpqrstvwxz"]
    rows += [(1000 + i, junk(kinds[i % 3], [10, 50, 200][i // 3 % 3]), None) for i in range(90)]
    got = {r.doc_id: r for r in identify_languages(docs(spark, rows)).collect()}
    clean = [got[i] for i in range(600) if got[i].held_out]
    assert len(clean) > 100 and sum(r.rejected for r in clean) <= 0.02 * len(clean)
    assert sum(got[1000 + i].rejected for i in range(90)) >= 86


def test_languages_of_many_labels_ties_and_repeated_rows(spark):
    word = lambda k: "".join(chr(97 + int(d)) for d in f"{k:03d}")
    rows = [(i, f"{word(i % 600)}x {word(i % 600)}y z{word(i % 600)}", f"l{i % 600:03d}") for i in range(2400)]
    got = {r.doc_id: r.lang_pred for r in identify_languages(docs(spark, rows)).collect()}
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(got.values()) <= learned and len(set(got.values())) > 500
    same = [(i, "the same text", "b" if i % 2 else "a") for i in range(40)] + [(50, "the same text", None)] * 2 + [(None, "the same text", "a")] * 2000
    got = identify_languages(docs(spark, same)).collect()
    assert len(got) == 2042 and {r.lang_pred for r in got} == {"a"}  # equally near: the first label


def test_languages_against_brute_force(spark):
    """Centroids of one cluster and cosines recomputed from n-gram counts."""
    rng = random.Random(21)
    vocab = {"en": "the of and to in is that it".split(), "de": "der die und zu den das nicht von".split()}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(4, 30))), lang) for i in range(80) for lang in [["de", "en"][i % 2]]]
    got = {r.doc_id: r for r in identify_languages(docs(spark, rows), clusters=1).collect()}
    vec = {i: np.log1p(counts(t, 4096).astype(np.float32)) for i, t, _ in rows}
    learn = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    idf = np.log((1 + len(learn)) / (1 + sum(vec[i] > 0 for i, _ in learn))) + 1
    unit = {i: v * idf / np.linalg.norm(v * idf) for i, v in vec.items()}
    mean = {lang: sum(unit[i] for i, x in learn if x == lang) for lang in vocab}
    cos = {i: {lang: float(unit[i] @ m / np.linalg.norm(m)) for lang, m in mean.items()} for i in vec}
    for i, c in cos.items():
        assert got[i].lang_pred == max(sorted(c), key=c.get) and got[i].score == pytest.approx(max(c.values()), abs=0.01)


def test_languages_without_labels(spark):
    assert identify_languages(docs(spark, [])).collect() == []
    assert identify_languages(docs(spark, [(1, "text")])).first().lang_pred == "und"


# ---- op 4


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("leaf", [8, 4096])
def test_near_texts_against_brute_force(spark, leaf):
    rng = random.Random(7)
    texts = [None, "", " \t", "One", "ONE two", "É one Two", "x y z " * 40_000]
    for _ in range(60):
        t = prose(rng, 200).split()
        texts.append(" ".join(t))
        if rng.random() < 0.5:
            t[rng.randrange(200)] = "changed"
            texts.append(" ".join(t))
    texts += texts[-3:]
    rows = list(enumerate(texts)) + [(5, "an id again with another text"), (None, "no id")]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in link_near_texts(docs(spark, rows), leaf=leaf).collect()]
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    fps = [(i, plain_fingerprint(t)) for i, t in rows if i is not None]
    root = union_find(len(texts), [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 3])
    assert Counter(got) == Counter([(i, f"{plain_fingerprint(t):016x}", None if i is None else root[i]) for i, t in rows])
    assert prints[0] == prints[1] == prints[2] == 0
    assert sum(r != i for i, r in enumerate(root)) > 6


def test_fingerprint_and_trees():
    assert fingerprint(None) == 0
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = fp.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    for n, many in ((1000, 4), (1 << 20, 10), (1 << 40, 20)):  # more fingerprints: more trees, each over more bits
        bits = masks(n, 3, 8)
        assert len(bits) == many
        trees = [VantageTree(fp[::3], m, 8) for m in bits]
        assert all(len(np.unique(t.point[t.child > 0])) > 20 for t in trees)  # nodes have vantage points of their own
        assert np.any([t.leaves(fp) == t.leaves(near) for t in trees], axis=0).all()
        assert all(np.bincount(t.leaves(fp)).max() < 400 for t in trees)
    both = np.concatenate([fp, near])
    got = {(int(min(i, j)), int(max(i, j))) for a, b in near_pairs(both, 3) for i, j in zip(a, b, strict=True) if i != j}
    apart = np.bitwise_count(both[:, None] ^ both[None, :])
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= 3), strict=True) if i < j} and len(got) >= 3000


def test_near_texts_empty(spark):
    assert link_near_texts(docs(spark, [])).collect() == []


# ---- op 5


def test_pieces_against_the_library(spark):
    rng = random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    parts = ["a", "the", " ", "  ", "\n", "▁", "é", "ñ", "😀", "中", "1", ".", "\t", "ing", "\0", "<s>", "<0x0A>", "ﬁ"]
    texts = [None, "", " ", "▁▁a b▁c", "x" * 20_000, "a b " * 20_000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in encode_documents(docs(spark, list(enumerate(texts))), PIECES).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
        src = (t or "").encode()
        assert len(r.ends) == len(ids) - 1 and ([0, *r.ends][-1] == len(src))
        for piece_id, a, b in zip(ids, [0, *r.ends], r.ends, strict=False):
            piece = library.id_to_piece(piece_id)
            assert a <= b
            if not library.is_byte(piece_id) and "▁" not in piece:
                assert src[a:b].decode() == piece


def test_pieces_in_empty_tables_and_repeated_rows(spark):
    assert encode_documents(docs(spark, []), PIECES).collect() == []
    got = encode_documents(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b")]), PIECES).collect()
    assert len(got) == 3 and len({r.ids_sha256 for r in got}) == 1 and sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]


def test_compiled_character_map():
    """A hand-made double array: `a` -> `x`, `ab` -> `yz`, longest prefix first."""
    units = [0] * 1024

    def put(at, label, offset, leaf):
        units[at] = label | (offset << 10) | (int(leaf) << 8)

    put(0, 0, 256, False)  # children of the root stand at 256 ^ label
    a = 256 ^ ord("a")
    put(a, ord("a"), 512, True)
    leaf_a = a ^ 512
    units[leaf_a] = 0x80000000 | 0
    b = leaf_a ^ ord("b")
    put(b, ord("b"), 256, True)
    units[b ^ 256] = 0x80000000 | 2
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"x\0yz\0"
    cm = CharacterMap(blob)
    assert cm.longest(b"abc", 0) == (b"yz", 2)
    assert cm.longest(b"ac", 0) == (b"x", 1)
    assert cm.longest(b"ba", 0) is None
    model = PieceModel(open(PIECES, "rb").read())
    model.map, model.plain = cm, False
    record = lambda t: (lambda norm, at: (norm, np.diff(at).tolist()))(*model.normalize(t))
    assert record("abéa b") == ("▁yzéx▁b", [0, 2, 0, 2, 1, 1, 1])
    model.squeeze = True
    assert record("  b  c ") == ("▁b▁c", [0, 3, 2, 2])


# ---- op 6


@pytest.mark.parametrize("hot", [False, True])
def test_shards(spark, hot):
    rng = random.Random(4)
    texts = [prose(rng, 3) for _ in range(60)] + [None, "", "é"]
    rows = [(i, rng.choice(texts)) for i in range(430)] + [(i, "hot" if hot else prose(rng, 4)) for i in range(430, 650)] + [(None, "x"), (3, "x"), (3, "x")]
    got = shard_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    key = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, *key(t)) for i, t in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    spread = defaultdict(set)
    for r in got:
        spread[r.size, r.text_crc32].add(r.shard)
    sizes = Counter(key(t) for _, t in rows)
    assert sum(len(spread[k]) > 1 for k in sizes if sizes[k] <= 16) <= (20 if hot else 8)  # of about 60; a shard of 16 rows holds two groups of 7
    assert all(r.cut_group == (len(spread[r.size, r.text_crc32]) > 1) for r in got)
    if hot:
        assert len(spread[key("hot")]) <= 220 // 16 + 2


def test_shards_come_from_propagation(spark):
    """Fewer (group, shard) pairs with rounds than without, and no more than cutting the rows in order of their text."""
    rng = random.Random(14)
    rows = [(i, prose(rng, 2)) for i in range(500)]
    rows += [(1000 + i, f"group {i % 130} of some") for i in range(600)] + [(3000 + i, "huge") for i in range(400)]

    def pairs(got):
        return len({(r.size, r.text_crc32, r.shard) for r in got})

    none, some = (shard_documents(docs(spark, rows), rounds=k).collect() for k in (0, 6))
    order = sorted((t, i) for i, t in rows)
    n, plain = len(rows), set()
    for at, (t, _) in enumerate(order):
        plain.add((t, at * 40 // n))
    assert pairs(some) < 0.65 * pairs(none) and pairs(some) <= len(plain)
    for got in (none, some):
        by = Counter(r.shard for r in got)
        assert len(by) == 40 and max(by.values()) - min(by.values()) <= 1
    huge = {r.shard for r in some if r.size == 20 and r.text_crc32 == zlib.crc32(b"huge")}
    assert len(huge) <= 400 // (n // 40) + 2


def test_shards_full_of_groups_and_long_texts(spark):
    """Every row in a group that fills a shard, and texts of a megabyte: still even."""
    rows = [(i, f"pack {i % 40} " + ("x" * 1_000_000 if i % 97 == 0 else "")) for i in range(400)] + [(7, "pack 0 "), (None, None), (None, None)]
    got = shard_documents(docs(spark, rows)).collect()
    by = Counter(r.shard for r in got)
    assert len(got) == len(rows) and len(by) == 40 and max(by.values()) - min(by.values()) <= 1
    assert max(r.size for r in got) > 1_000_000


def test_shards_of_few_rows(spark):
    assert shard_documents(docs(spark, [])).collect() == []
    assert sorted((r.shard, r.slot) for r in shard_documents(docs(spark, [(1, "a"), (2, "a")])).collect()) == [(0, 0), (1, 0)]


# ---- op 7


@pytest.mark.parametrize(("hot", "capacity"), [(1024, 4096), (4, 4)])
def test_exact_groups(spark, hot, capacity):
    rng = random.Random(6)
    texts = [None, "", "a", "A", "é", "long " * 50_000] + [prose(rng, 3) for _ in range(40)]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(i, "hot") for i in range(200, 300)] + [(7, "twice"), (7, "twice"), (None, "hot"), (None, "alone"), (None, "alone")]
    got = exact_dedup(docs(spark, rows), hot=hot, capacity=capacity).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), sha(t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({sha(t): 1 for t in groups}) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_directory_doubles_and_splits():
    depth, directory = build_directory({0: 10, 1: 10, 128: 3}, 8, 12)
    assert depth == 8 and len(directory) == 256
    assert directory[0] != directory[1] and directory[128] == directory[255] == 128 and directory[2] == directory[3]
    assert build_directory({}, 8, 12) == (0, [0])
    assert build_directory({5: 100}, 3, 1)[0] == 3


def test_exact_empty_and_carried_columns(spark):
    assert exact_dedup(docs(spark, [])).collect() == []
    got = exact_dedup(docs(spark, [(1, "a", "en"), (2, "a", "de"), (3, None, None)]), columns=["doc_id", "text", "lang", "kept"]).filter("kept").select("row.*").collect()
    assert sorted(map(tuple, got)) == [(2, "a", "de", True), (3, None, None, True)]


# ---- op 8


def test_mix(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(40)), None, rng.choice(["b", "a", "é", "z", None, "Z"])) for i in range(600)] + [(600, None, None, "none"), (601, "", None, "none"), (None, "w w", None, "a"), (1, "again", None, "a")]
    got = mix_sources(docs(spark, rows)).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    totals = Counter()
    for _, t, _, s in rows:
        totals[s] += size(t)
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None]
    weight, left, open_, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(totals.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * totals[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
            open_.remove(s)
    target |= share
    source = {(i, t): s for i, t, _, s in rows}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _, _ in rows)
    for r in got:
        assert r.taken == r.size * r.copies <= 2 * r.size
    by = {}
    for r in got:
        by[r.target] = by.get(r.target, 0) + r.taken
    assert {round(t, 6) for t in by} == {round(t, 6) for t in target.values()}
    assert sum(by.values()) == pytest.approx(1.5 * sum(totals.values()), rel=0.05)
    assert len(source) and sorted(map(tuple, mix_sources(docs(spark, rows)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mix_empty(spark):
    assert mix_sources(docs(spark, [])).collect() == []


# ---- op 9


def brute_repeats(rows, least=20):
    found = []
    for i, t in rows:
        at = 0
        for k, line in enumerate((t or "").split("\n")):
            w = line.lower().split()
            if len(w) >= least and i is not None:
                found.append((i, k, at, at + len(line), w))
            at += len(line) + 1
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for *_, w in found]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = union_find(len(found), links)
    groups = defaultdict(list)
    for n, r in enumerate(root):
        groups[r].append(n)
    out = []
    for members in groups.values():
        if len(members) > 1:
            keep = min(found[m][:2] for m in members)
            out += [(*found[m][:4], *keep, len(members), found[m][:2] == keep) for m in members]
    return sorted(out)


@pytest.mark.parametrize("cap", [4, 8192])
def test_paragraphs_against_brute_force(spark, cap):
    rng = random.Random(9)
    passage = prose(rng, 60).split()
    texts = [None, "", "short line\nshort line", prose(rng, 30_000)]
    for i in range(40):
        mine = list(passage)
        mine[rng.randrange(60)] = f"edit{i % 4}"
        lines = [prose(rng, rng.randrange(5, 40)) for _ in range(3)]
        if i % 2:
            lines.insert(rng.randrange(4), " ".join(mine))
        if i % 5 == 0:
            lines.insert(0, "This exact line of é words " * 5)
        texts.append("\n".join(lines))
    rows = list(enumerate(texts)) + [(None, texts[5])]
    got = repeated_paragraphs(docs(spark, rows), cap=cap).collect()
    assert sorted((r.doc_id, r.paragraph, r.start, r.end, r.keep_doc_id, r.keep_paragraph, r.n_repeats, r.kept) for r in got) == brute_repeats(rows)
    assert len(got) > 20


def test_passages_inside_lines_and_over_line_breaks(spark):
    rng = random.Random(4)
    planted = [[prose(rng, 1) for _ in range(55)] for _ in range(12)]
    rows = []
    for k, p in enumerate(planted):
        broken = "\n".join(" ".join(p[a : a + 7]) for a in range(0, 55, 7))
        rows += [(3 * k, f"{prose(rng, 150)} {' '.join(p)} {prose(rng, 90)}"), (3 * k + 1, f"{prose(rng, 40)}\n{prose(rng, 200)} {' '.join(p)}"), (3 * k + 2, f"{prose(rng, 30)} {broken}\n{prose(rng, 25)}")]
    rows += [(900 + i, prose(rng, 300)) for i in range(20)]
    text = dict(rows)
    got = repeated_paragraphs(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(36))
    for r in got:
        words = text[r.doc_id][r.start : r.end].split()
        assert len(words) == r.n_words and " ".join(words) in " ".join(planted[r.doc_id // 3])
        assert r.keep_doc_id // 3 == r.doc_id // 3 and r.kept == (r.doc_id == r.keep_doc_id) and r.n_repeats in (2, 3)
        assert r.paragraph == text[r.doc_id][: r.start].count("\n")
    assert all(sum(r.n_words for r in got if r.doc_id == i) == 55 for i in range(36))


def _stretches(a, b, least=20, words=5, threshold=0.8):
    """Brute force: the longest stretch of words a whose shingles are near those of a stretch of b, by every start and end on the grid of equal words."""
    best = None
    for d in range(-len(a), len(b)):
        same = [i for i in range(max(0, -d), min(len(a), len(b) - d)) if a[i] == b[i + d]]
        if len(same) < least // 2:
            continue
        for lo in same:
            for hi in same:
                if hi - lo + 1 >= least and (best is None or hi - lo > best[1] - best[0]):
                    x, y = ({tuple(t[j : j + words]) for j in range(u, u + hi - lo + 2 - words)} for t, u in ((a, lo), (b, lo + d)))
                    if len(x & y) >= threshold * len(x | y):
                        best = (lo, hi)
    return best


@pytest.mark.parametrize(("size", "edits"), [(51, 0), (60, 1), (100, 2)])
def test_near_passages_inside_lines_against_brute_force(spark, size, edits):
    rng = random.Random(size)
    word = lambda: f"{rng.choice('bcdfgh')}{rng.randrange(3000)}"
    rows, brute = [], {}
    for k in range(24):
        one = [word() for _ in range(size)]
        two = list(one)
        for e in rng.sample(range(size), edits):
            two[e] = f"changed{k}"
        a, b = ([word() for _ in range(rng.randrange(50, 120))] + p + [word() for _ in range(rng.randrange(50, 120))] for p in (one, two))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        brute[2 * k + 1] = (b, _stretches(b, a))
    clean = [(900 + i, " ".join(word() for _ in range(250))) for i in range(24)]
    got = repeated_paragraphs(docs(spark, rows + clean)).collect()
    assert {r.doc_id for r in got} == set(range(48))  # each pair, no clean text
    text = dict(rows)
    marked = {i: set() for i in brute}
    for r in got:
        assert len(text[r.doc_id][r.start : r.end].split()) == r.n_words >= 20
        assert r.kept == (r.doc_id % 2 == 0) and r.keep_doc_id == r.doc_id // 2 * 2
        if not r.kept:
            at = len(text[r.doc_id][: r.start].split())
            marked[r.doc_id] |= set(range(at, at + r.n_words))
    shares = []
    for i, (words, (lo, hi)) in brute.items():
        assert marked[i] <= set(range(lo - 3, hi + 4))  # nothing beyond the passage
        shares.append(len(marked[i] & set(range(lo, hi + 1))) / (hi + 1 - lo))
    assert sum(s >= 0.9 for s in shares) >= 0.9 * len(shares) and sum(shares) >= 0.95 * len(shares)


def test_a_passage_of_very_many_texts_and_repeats_inside_one(spark):
    rng = random.Random(8)
    passage = prose(rng, 40)
    rows = [(i, f"{prose(rng, 60)} {passage} {prose(rng, 30)}") for i in range(300)]
    twice = prose(rng, 50)
    rows += [(900, f"{prose(rng, 40)} {twice} {prose(rng, 45)} {twice} {prose(rng, 40)}"), (901, "the same words again " * 300), (902, None), (None, rows[0][1])]
    rows.append(rows[5])  # a repeated row
    text = dict(rows)
    got = repeated_paragraphs(docs(spark, rows)).collect()
    gone = [r for r in got if not r.kept and r.doc_id is not None and r.doc_id < 300]
    assert {r.doc_id for r in gone if passage in text[r.doc_id][r.start : r.end]} >= set(range(1, 300)) - {5}  # words beside it may be equal too
    # a longer stretch may go in favour of a text whose shorter one goes itself; the first text stays
    assert all(r.keep_doc_id < r.doc_id for r in gone if r.doc_id != 5) and sum(r.keep_doc_id == 0 for r in gone) > 250
    assert 0 not in {r.doc_id for r in gone} and any(r.kept and r.doc_id == 0 for r in got)
    inside = [text[900][r.start : r.end] for r in got if r.doc_id == 900]
    assert inside == [twice, twice] and sorted(r.kept for r in got if r.doc_id == 900) == [False, True]
    assert None not in {r.doc_id for r in got} and 902 not in {r.doc_id for r in got}


def test_paragraphs_empty(spark):
    assert repeated_paragraphs(docs(spark, [])).collect() == []


# ---- op 10


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, 3 * BLOCK + 7])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65_536, n), rng.integers(0, 4, n), np.full(n, 70_000), np.zeros(n)):
        ids = ids.astype(np.uint32)
        names, lengths, back = unpack(pack([5, None], np.array([n, 0]), ids))
        assert names == [5, None] and lengths.tolist() == [n, 0] and (back == ids).all()


def test_damage_is_noticed():
    ids = np.arange(2 * BLOCK, dtype=np.uint32)
    good = pack([1], np.array([len(ids)]), ids)
    for at in (2, 30, len(good) - 40):
        bad = bytearray(good)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            unpack(bytes(bad))
    assert len(pack([1], np.array([BLOCK]), np.tile(np.arange(8, dtype=np.uint32), BLOCK // 8))) < BLOCK // 2


@pytest.mark.parametrize("file_ids", [50, 1 << 21])
def test_token_files(spark, file_ids):
    rng = random.Random(10)
    texts = [None, "", "<|endoftext|>", "é😀 x", "word " * 3000] + [prose(rng, rng.randrange(30)) for _ in range(100)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    files = write_token_files(docs(spark, rows), BYTES, file_ids=file_ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(files).collect()}
    tokenizer, at = Tokenizer.from_file(BYTES), 0
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert files.count() > (3 if file_ids == 50 else 0)


def test_token_files_with_repeated_and_missing_ids(spark):
    got = read_token_files(write_token_files(docs(spark, [(2, "b"), (None, "x y"), (2, "b"), (1, "a")]), BYTES)).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 2, 2]
    assert read_token_files(write_token_files(docs(spark, []), BYTES)).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no tables here")
def test_coder_beats_zlib_on_texts(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(200).collect()]
    ids = np.concatenate([np.array([*e.ids, 0], np.uint32) for e in Tokenizer.from_file(BYTES).encode_batch_fast(texts, add_special_tokens=False)])
    payload = pack([1], np.array([len(ids)]), ids)
    plain = sum(len(zlib.compress(ids[a : a + BLOCK].astype("<u2").tobytes(), 9)) for a in range(0, len(ids), BLOCK))
    assert (unpack(payload)[2] == ids).all() and len(payload) < 0.85 * plain


def test_ids_beyond_the_range_raise():
    with pytest.raises(ValueError, match="below"):
        pack([1], np.array([1]), np.array([1 << 20], np.uint32))
