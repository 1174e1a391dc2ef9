"""Runs of words that repeat with a period, found by splitting texts at rare words and scanning what is left lag by lag.

A run of at least four periods holds each of its words four times or more. So words that occur fewer times in a segment stand in no run
of it and split it; the pieces are segments of their own, in which other words have become rare. When nothing splits any more, most
texts are gone. The surviving segments are scanned at every lag: a run with period q and four periods covers three neighbouring blocks
[jq, (j+1)q) whole, so only blocks at multiples of q are compared, by hashes of prefixes, which makes m log m comparisons for m words.
Stretches found are extended by binary search over the same hashes and then compared word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklines.llm.words import mixed

#: Words worked on at once; a longer text is worked on alone.
BATCH = 1 << 16
#: Periods that a run has at least, and words that it has at least.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Lags up to this are scanned one by one over all blocks, longer ones block by block over all lags.
SHORT_LAGS = 256
#: Rounds of splitting after which segments are scanned as they are; the result is the same.
ROUNDS = 256
_BASE, _GOLD = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def split_rare(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, segments) of the words that survive: runs of consecutive places of one group in which every word is frequent enough."""
    at, seg = np.arange(len(ids)), group.astype(np.int64)
    done_at, done_seg, base, wide = [], [], 0, int(ids.max(initial=0)) + 1
    for _ in range(ROUNDS):
        if not len(at):
            break
        _, inverse, times = np.unique(seg * wide + ids[at], return_inverse=True, return_counts=True)
        keep = times[inverse] >= LEAST_PERIODS
        hurt = np.zeros(int(seg[-1]) + 1, bool)
        hurt[seg[~keep]] = True
        whole = ~hurt[seg]
        done_at.append(at[whole])
        done_seg.append(seg[whole] + base)
        base += int(seg[-1]) + 1
        keep &= ~whole
        at, seg = at[keep], seg[keep]
        if len(at):
            seg = np.concatenate([[0], np.cumsum((np.diff(at) != 1) | (np.diff(seg) != 0))])
            fits = np.bincount(seg)[seg] >= LEAST_WORDS
            at, seg = at[fits], seg[fits]
    done_at.append(at)
    done_seg.append(seg + base)
    at, seg = np.concatenate(done_at), np.concatenate(done_seg)
    order = np.argsort(at, kind="stable")
    return at[order], seg[order]


class _Prefixes:
    """Hashes of all stretches of a sequence: equal stretches have equal ones."""

    def __init__(self, z: np.ndarray):
        value = mixed((z.astype(np.uint64) + np.uint64(1)) * _GOLD)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(z), _BASE))])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value * self.power[:-1])])

    def same(self, at: np.ndarray, size: np.ndarray, lag: np.ndarray) -> np.ndarray:
        """Whether the stretches of a size at `at` and at `at + lag` are equal."""
        s = self.sums
        return (s[at + size] - s[at]) * self.power[lag] == s[at + lag + size] - s[at + lag]

    def reach(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from `at` on (or before it) equal those a lag later, by binary search."""
        low, high = np.zeros_like(most), most
        while (low < high).any():
            mid = (low + high + 1) >> 1
            good = self.same(at - mid if back else at, mid, lag)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def _triples(h: _Prefixes, m: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of the first of three equal neighbouring blocks at multiples of the lag; of more in a row only the first three."""
    lags = min(m, longest) // LEAST_PERIODS
    places, periods = [], []
    for q in range(1, min(lags, SHORT_LAGS) + 1):
        block = np.diff(h.sums[::q])
        same = block[:-1] * h.power[q] == block[1:]
        three = same[:-1] & same[1:]
        j = np.flatnonzero(three)
        if len(j):
            j = j[(j == 0) | ~three[j - 1]]
            places.append(j * q)
            periods.append(np.full(len(j), q))
    before = np.zeros(0, bool)
    for j in range(m // (SHORT_LAGS + 1) if lags > SHORT_LAGS else 0):
        q = np.arange(SHORT_LAGS + 1, min(lags, m // (j + 3)) + 1)
        if not len(q):
            break
        three = h.same(j * q, q, q)
        some = np.flatnonzero(three)
        three[some] = h.same((j + 1) * q[some], q[some], q[some])
        first = np.flatnonzero(three & ~before[: len(q)] if j else three)
        places.append(j * q[first])
        periods.append(q[first])
        before = three
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def lag_scan(z: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in z whose length is at most `longest`, by start, then period."""
    h = _Prefixes(z)
    p, q = _triples(h, len(z), longest)
    if not len(p):
        return []
    right = h.reach(p, q, len(z) - q - p, back=False)
    left = h.reach(p, q, p, back=True)
    start, end = p - left, p + right + q
    long_ = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    order = np.lexsort((q[long_], end[long_], start[long_]))
    found, last = [], None
    for a, b, lag in zip(start[long_][order].tolist(), end[long_][order].tolist(), q[long_][order].tolist(), strict=True):
        if last == (a, b):  # a multiple of the period found already
            continue
        last = (a, b)
        if not np.array_equal(z[a : b - lag], z[a + lag : b]):  # unequal stretches with equal hashes
            return _plain_scan(z, longest)
        found.append((a, b - a, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _plain_scan(z: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """lag_scan() by comparing all words at every lag."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, min(len(z), longest) // LEAST_PERIODS + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (z[:-q] == z[q:]).view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b + q - a >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.setdefault((a, b + q), q)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(ids: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of words; none crosses from one group to the next. Groups ascend."""
    at, seg = split_rare(ids, group)
    if not len(at):
        return []
    fresh = np.concatenate([[False], np.diff(seg) != 0])
    shift = np.cumsum(fresh)  # a word that occurs nowhere else stands before each further segment
    z, place = np.empty(len(at) + shift[-1], np.int64), np.empty(len(at) + shift[-1], np.int64)
    walls = np.flatnonzero(fresh)
    z[np.arange(len(at)) + shift], place[np.arange(len(at)) + shift] = ids[at], at
    z[walls + np.arange(len(walls))] = int(ids.max()) + 1 + np.arange(len(walls))
    longest = int(np.diff(np.concatenate([[0], walls, [len(at)]])).max())
    return [(int(place[a]), n, q) for a, n, q in lag_scan(z, longest)]


def periodic_places(doc_id: int, n: int) -> tuple[int, int] | None:
    """(a, p) of a document whose words from a on are to repeat with period p; None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _results(held: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    """A row of SCHEMA for each (doc_id, words)."""
    number: dict[bytes, int] = {}
    sizes = [len(words) for _, words in held]
    ids = np.fromiter((number.setdefault(w, len(number)) for _, words in held for w in words), np.int64, sum(sizes))
    begin = np.cumsum([0, *sizes])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in held]
    if len(ids):
        starts = runs_of(ids, np.repeat(np.arange(len(held)), sizes))
        for k, (a, n, q) in zip(np.searchsorted(begin, [r[0] for r in starts], side="right") - 1, starts, strict=True):
            runs[k].append((a - int(begin[k]), n, q))
    for (doc_id, words), own in zip(held, runs, strict=True):
        best: tuple | None = None
        change = np.zeros(len(words) + 1 if own else 0, np.int64)
        for a, n, q in own:  # by start, then period: of equals the first stays
            change[a + q] += 1
            change[a + n] -= 1
            if best is None or n * best[2] > best[1] * q:
                best = (a, n, q)
        if own:
            words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in own)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        yield doc_id, len(own), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """Runs of repeated words in docs(doc_id, text); other columns are ignored. One row comes back for each input row.

    A run is a stretch of words with smallest period q and at least 4 q words and 6, which no neighbouring word extends. The row gives
    their number, the run that repeats most often (ties: smallest start, then period; null without a run), and digests of all runs
    and of the words that no run holds after its first period. Words are split at the white space of ASCII.
    planted: documents chosen by the checksum of their id are made periodic first (periodic_places()); rows without an id never are.

    Null and empty texts have no words and no runs. Rows that repeat an id are rows like others. Texts are worked on whole, a few short
    ones together, so memory follows the longest text; nothing is shuffled. Empty tables give empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def table(held: list) -> pa.RecordBatch:
        cols = list(zip(*_results(held), strict=True))
        types = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = text.as_py().split()
                if planted and doc_id is not None and (places := periodic_places(doc_id, len(words))):
                    a, p = places
                    words = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
                if held and size + len(words) > BATCH:
                    yield table(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words)
        if held:
            yield table(held)

    return rows.mapInArrow(found, SCHEMA)
