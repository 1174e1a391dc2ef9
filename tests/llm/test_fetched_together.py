"""op9: the words of many asked stretches and lines are fetched together, with few array operations; same rows as text by text."""

import random

import numpy as np
import pyarrow as pa

from sparklines.llm import paragraph_dedup
from sparklines.llm.paragraph_dedup import line_keys
from sparklines.llm.words import shingle_hashes, word_table


def texts(rng, n):
    return ["\n".join(" ".join(rng.choice(["aé", "b", "c", "dd"]) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def needs(rng, text):
    starts, _, hashes, breaks = word_table(text)
    edge = np.searchsorted(starts, [0, *breaks, len(text)])
    for k, (a, b) in enumerate(zip(edge.tolist(), edge[1:].tolist(), strict=False)):
        if b - a >= 20:
            k1, k2 = (int(x[0]) for x in line_keys(hashes[a:b], np.zeros(1, np.int64)))
            known = rng.random() < 0.8
            yield {"paragraph": k, "id": rng.randrange(1 << 40), "k1": k1 + (not known), "k2": k2}, np.unique(shingle_hashes(hashes[a:b], 5)).tobytes() if known else None
    yield {"paragraph": 9, "id": 1, "k1": 2, "k2": 3}, None  # a line that this text lacks


def counted(monkeypatch, names):
    calls = []
    for name in names:
        f = getattr(paragraph_dedup, name)
        monkeypatch.setattr(paragraph_dedup, name, lambda *a, f=f: (calls.append(1), f(*a))[1])
    return calls


def test_shingles_of_needed_lines(monkeypatch):
    rng = random.Random(1)
    held = texts(rng, 300)
    told = [list(needs(rng, t)) for t in held]
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())]))
    batch = pa.record_batch([pa.array(held), pa.array([[n for n, _ in x] for x in told], kind)], names=["text", "need"])
    calls = counted(monkeypatch, ["line_keys", "shingle_hashes"])
    got = pa.Table.from_batches(paragraph_dedup._shingle_sets(5)(iter([batch]))).to_pydict()
    want = [(n["id"], s) for x in told for n, s in x if s is not None]
    assert list(zip(got["id"], got["shingles"], strict=True)) == want and len(want) > 100
    assert len(calls) < 10


def test_windows_of_many_texts():
    rng = random.Random(2)
    held = ["", *texts(rng, 200)]
    asks = [[{"lo": (a := rng.randrange(max(1, len(t)))), "hi": a + 1 + rng.randrange(30)} for _ in range(rng.randrange(1, 4))] for t in held]
    batch = pa.record_batch([pa.array(range(len(held)), pa.int64()), pa.array(held), pa.array(asks, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))], names=["rid", "text", "asks"])
    got = iter(pa.Table.from_batches(paragraph_dedup._windows(6)(iter([batch]))).to_pylist())
    for rid, (text, of) in enumerate(zip(held, asks, strict=True)):
        starts, ends, hashes, breaks = word_table(text)
        for ask in of if len(starts) else []:
            a, b = max(0, np.searchsorted(starts, ask["lo"]) - 6), min(len(starts), np.searchsorted(starts, ask["hi"]) + 6)
            row, inner = next(got), (breaks > starts[a]) & (breaks < ends[b - 1])
            assert row["rid"] == rid and row["ask"] == ask and row["line"] == (breaks < starts[a]).sum()
            assert row["s"] == starts[a:b].tolist() and row["e"] == ends[a:b].tolist() and row["breaks"] == breaks[inner].tolist()
            assert row["w"] == hashes[a:b].astype(np.uint32).view(np.int32).tolist()
    assert next(got, None) is None
