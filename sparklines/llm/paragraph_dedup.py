"""Repeated passages: MinHash bands over paragraphs propose pairs, exact Jaccard confirms them, components decide.

A paragraph is a line of a text. Paragraphs with the same words are one from the start, so only different
ones are hashed into bands and compared. What repeats inside longer lines or over line breaks is found by pieces:
the words of the whole text are cut where they themselves say, so that a passage falls into the same pieces wherever it
stands. A piece has so few shingles that a Jaccard similarity of 0.8 means equal words, hence one key is its only band. Pieces that
repeat are compared by their words and grow, word by word in both texts and over changed words, to passages of an exact
Jaccard similarity of 0.8 or more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklines.llm.common import block_pairs, cut, drop, map_groups
from sparklines.llm.components import connected_components
from sparklines.llm.words import band_keys, mixed, run_keys, shingle_hashes, word_batches

_GOLD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


def line_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys for each run of words; runs are the same if both are."""
    return run_keys(hashes, starts).view(np.int64), run_keys(mixed(hashes ^ _OTHER), starts).view(np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all ranges starts[i] ... starts[i] + counts[i] - 1, where each range begins among them)."""
    ends = np.cumsum(counts)
    begin = ends - counts
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - begin, counts), begin


def piece_ends(hashes: np.ndarray, doc: np.ndarray, reach: int) -> np.ndarray:
    """Where pieces end among the words of texts (doc: the text of each word): after words whose pair hash is the least within `reach` words, ties going to the first.

    A cut depends on `reach` words on either side (and one before) alone, so a passage is cut alike wherever it
    stands. Pieces inside a text have `reach` words or more, 2 x reach + 1 on average. Where a few words are said over
    and over no hash is the least alone: pieces of over 24 words are cut every 12 (a multiple of such periods) from their least.
    """
    n = len(hashes)
    h = hashes.copy()
    same = doc[1:] == doc[:-1]
    h[1:] += np.where(same, hashes[:-1] * _GOLD, np.uint64(0))
    h = mixed(h)
    least = np.ones(n, bool)
    for d in range(1, min(reach, n - 1) + 1):
        apart = doc[d:] != doc[:-d]
        less = h[d:] < h[:-d]
        least[d:] &= less | apart
        least[:-d] &= ~less | apart
    least[:-1] |= ~same
    least[-1:] = True
    at = np.flatnonzero(least) + 1
    starts = np.concatenate([[0], at[:-1]])
    more = []
    for a, b in zip(starts[at - starts > 24].tolist(), at[at - starts > 24].tolist(), strict=True):
        more.append(np.arange(a + reach + int(np.argmin(h[a + reach : b - reach])) + 1, b - reach, 12))
    return np.unique(np.concatenate([at, *more])) if more else at


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    """Lists for owners 0 to n - 1 of values in order of their owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _cut_texts(ids: list[int], rows: list[int], texts: list[str], words: int, least: int, bands: int, band_rows: int, reach: int):
    """For each text: its lines of at least `least` words and its pieces of at least `words` words, as rows of _FIELDS."""
    at = 0
    for held, starts, ends, hashes, doc, breaks, _begin in word_batches(texts):
        n = len(held)
        line = np.searchsorted(breaks, starts)  # breaks also hold the places between texts
        base = np.searchsorted(breaks, _begin)  # the first line of each text
        number, counts = np.unique(line, return_counts=True)
        first = np.cumsum(counts) - counts
        long_ = counts >= least
        number, counts, first = number[long_], counts[long_], first[long_]
        owner = doc[first] if len(first) else np.zeros(0, np.int64)
        edges = np.concatenate([[-1], breaks, [_begin[-1] + len(held[-1])]])
        inside, begin = _ranges(first, counts)
        k1, k2 = line_keys(hashes[inside], begin)
        cuts, of = _ranges(first, counts - words + 1)
        keys = band_keys(shingle_hashes(hashes, words)[cuts], of, bands, band_rows) if len(of) else np.zeros((0, bands), np.int64)
        lines = pa.StructArray.from_arrays(
            [
                pa.array(number - base[owner], pa.int32()), pa.array(edges[number] + 1 - _begin[owner], pa.int64()), pa.array(edges[number + 1] - _begin[owner], pa.int64()),
                pa.array(counts, pa.int32()), pa.array(k1), pa.array(k2),
                pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * bands, pa.int32()), pa.array(keys.ravel())),
            ],
            ["paragraph", "start", "end", "n_words", "k1", "k2", "bands"],
        )
        stop = piece_ends(hashes, doc, reach) if len(hashes) else np.zeros(0, np.int64)
        begun = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(stop) else stop
        key = run_keys(hashes, begun).view(np.int64)
        some = stop - begun >= words
        begun, stop, key = begun[some], stop[some], key[some]
        of_piece, t = doc[begun], _begin[doc[begun]]
        flat = [key, starts[begun] - t, ends[stop - 1] - t, line[begun] - base[of_piece], line[stop - 1] - base[of_piece]]
        kinds = [pa.int64(), *[pa.int32()] * 4]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[at : at + n], pa.int64()), pa.array(ids[at : at + n], pa.int64()), _lists(lines, owner, n), *(_lists(pa.array(v, k), of_piece, n) for v, k in zip(flat, kinds, strict=True))],
            names=["rid", "doc_id", "lines", "keys", "starts", "ends", "firsts", "lasts"],
        )
        at += n


_LINE = "paragraph:int,start:long,end:long,n_words:int,k1:long,k2:long,bands:array<long>"
_FIELDS = f"rid long, doc_id long, lines array<struct<{_LINE}>>, keys array<long>, starts array<int>, ends array<int>, firsts array<int>, lasts array<int>"


def _same(h: np.ndarray, g: np.ndarray) -> int:
    """How many words two runs have in common from their beginning."""
    n = min(len(h), len(g))
    apart = np.flatnonzero(h[:n] != g[:n])
    return int(apart[0]) if len(apart) else n


#: Changed words that growth may step over, in either text, the fewest first.
_STEPS = sorted(((x, y) for x in range(4) for y in range(4) if x or y), key=lambda s: (sum(s), abs(s[0] - s[1])))


def _grown(
    h: np.ndarray, g: np.ndarray, hs: list[int], gs: list[int], seeds: list[tuple[int, int, int, int]], words: int, threshold: float
) -> list[tuple[int, int, int, int]]:
    """Stretches (a, b, ka, kb) in which the words h[a:b] and g[ka:kb] repeat each other, grown from equal runs of words in order.
    hs, gs: hashes of their shingles of `words` words (none if they are fewer).

    Each run is compared word by word and grows to both sides while words are equal. Neighbouring runs join, and the ends step over up to
    three changed words that `words` equal ones follow, while the exact Jaccard similarity of the shingles is at least threshold.
    A step is only counted out where the shingle behind it is the same in both: without that fewer than `words` words would be.
    """

    def near(a: int, b: int, ka: int, kb: int) -> bool:
        mine, other = set(hs[a : b - words + 1]), set(gs[ka : kb - words + 1])
        return bool(mine) and len(mine & other) >= threshold * len(mine | other) - 1e-9

    runs: list[tuple[int, int, int, int]] = []
    for a, b, ka, kb in seeds:
        lo, klo = (runs[-1][1], runs[-1][3]) if runs else (0, 0)
        if a < lo or ka < klo or b - a != kb - ka or not (h[a:b] == g[ka:kb]).all():
            continue  # growth has passed it already, or other words have the same key
        left = _same(h[lo:a][::-1], g[klo:ka][::-1])
        right = _same(h[b:], g[kb:])
        runs.append((a - left, b + right, ka - left, kb + right))
    joined: list[tuple[int, int, int, int]] = []
    for run in runs:
        if joined and near(*(whole := (joined[-1][0], run[1], joined[-1][2], run[3]))):
            joined[-1] = whole
        else:
            joined.append(run)
    out = []
    for k, (a, b, ka, kb) in enumerate(joined):
        hi, khi = (joined[k + 1][0], joined[k + 1][2]) if k + 1 < len(joined) else (len(h), len(g))
        lo, klo = (out[-1][1], out[-1][3]) if out else (0, 0)
        more = True
        while more:
            more = False
            for x, y in _STEPS:
                if b + x + words > hi or kb + y + words > khi or hs[b + x] != gs[kb + y]:
                    continue
                n = _same(h[b + x : hi], g[kb + y : khi])
                if n >= words and near(a, b + x + n, ka, kb + y + n):
                    b, kb, more = b + x + n, kb + y + n, True
                    break
            for x, y in _STEPS:
                if a - x - words < lo or ka - y - words < klo or hs[a - x - words] != gs[ka - y - words]:
                    continue
                n = _same(h[lo : a - x][::-1], g[klo : ka - y][::-1])
                if n >= words and near(a - x - n, b, ka - y - n, kb):
                    a, ka, more = a - x - n, ka - y - n, True
                    break
        out.append((a, b, ka, kb))
    return out


_WINDOW = "w array<int>, s array<int>, e array<int>, breaks array<int>, line int"
_SEED = "struct<start:int,end:int,k_start:int,k_end:int>"
_ASK = f"struct<kid:long,lo:int,hi:int,doc_id:long,k_rid:long,k_doc:long,n:long,seeds:array<{_SEED}>>"


def _listed(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(all values of lists that aren't null, where each list begins among them, with their number at the end)."""
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _list_column(values: list[np.ndarray], counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values])))


def _batches_of(texts: list[str], at: np.ndarray) -> Iterator[tuple]:
    """word_batches() of texts that ask for the entries at[k] ... at[k + 1] - 1 each, with the asked entries and the text of each in its batch."""
    k = 0
    for words in word_batches(texts):
        n = len(words[0])
        yield np.arange(at[k], at[k + n]), np.repeat(np.arange(n), np.diff(at[k : k + n + 1])), *words
        k += n


class _Places:
    """Ascending places in each of many lists, looked up in all of them at once."""

    def __init__(self, lists: pa.ListArray):
        values, self.begin = _listed(lists)
        self.values = values.to_numpy()
        self.keys = np.repeat(np.arange(len(lists)) << 32, np.diff(self.begin)) + self.values

    def find(self, rows: np.ndarray, at: np.ndarray, side: str = "left") -> np.ndarray:
        return np.searchsorted(self.keys, (rows << 32) + at, side) - self.begin[rows]

    def take(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.values[self.begin[rows] + at]


def _windows(edge: int):
    """For rows (rid, text, asks): the words of each asked stretch and `edge` words on either side, with their places."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks, at = _listed(batch.column(2))
            field = dict(zip((f.name for f in asks.type), asks.flatten(), strict=True))
            lo, hi = field["lo"].to_numpy(), field["hi"].to_numpy()
            parts: dict[str, list] = {k: [] for k in ("w", "s", "e", "breaks", "n", "n_breaks", "line", "took")}
            for took, text, _, starts, ends, hashes, doc, breaks, begin in _batches_of(batch.column(1).to_pylist(), at):
                first_word = np.searchsorted(doc, np.arange(len(begin) + 1))
                some = first_word[text + 1] > first_word[text]  # else another text of the same rid
                took, text = took[some], text[some]
                t, low, high = begin[text], first_word[text], first_word[text + 1]
                first = np.maximum(low, np.clip(np.searchsorted(starts, lo[took] + t), low, high) - edge)
                last = np.minimum(high, np.clip(np.searchsorted(starts, hi[took] + t), low, high) + edge)
                line, end_line = np.searchsorted(breaks, starts[first]), np.searchsorted(breaks, ends[last - 1])
                inside, between = _ranges(first, last - first)[0], _ranges(line, end_line - line)[0]
                of_word = np.repeat(t, last - first)
                found = {
                    "w": (hashes[inside] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), "s": (starts[inside] - of_word).astype(np.int32), "e": (ends[inside] - of_word).astype(np.int32),
                    "breaks": (breaks[between] - np.repeat(t, end_line - line)).astype(np.int32), "n": last - first, "n_breaks": end_line - line,
                    "line": (line - np.searchsorted(breaks, begin)[text]).astype(np.int32), "took": took,
                }
                for k, v in found.items():
                    parts[k].append(v)
            flat = {k: np.concatenate([np.zeros(0, np.int64), *parts.pop(k)]) for k in ("n", "n_breaks", "line", "took")}
            lists = [_list_column(v, flat["n_breaks" if k == "breaks" else "n"]) for k, v in parts.items()]
            of = np.repeat(np.arange(batch.num_rows), np.diff(at))[flat["took"]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), asks.take(pa.array(flat["took"])), *lists, pa.array(flat["line"], pa.int32())], names=["rid", "ask", *parts, "line"])

    return fetched


_GROWN = "rid long, doc_id long, start int, end int, paragraph int, n_words int, k_rid long, k_doc long, k_start int, k_end int, k_paragraph int, k_words int, n long"


#: Rows whose words are worked on together in growth.
TOGETHER = 256


def _grow(words: int, threshold: float, passage: int):
    names = [f.split()[0] for f in _GROWN.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64()]

    def grown(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = dict(zip(batch.schema.names, batch.columns, strict=True))
        ask = dict(zip((f.name for f in cols["ask"].type), cols["ask"].flatten(), strict=True))
        rid, k_rid = cols["rid"].to_numpy(), ask["k_rid"].to_numpy()
        (w, begin), (k_w, k_begin) = ((v.to_numpy(), at) for v, at in (_listed(cols["w"]), _listed(cols["k_w"])))
        s, e, k_s, k_e, breaks, k_breaks = (_Places(cols[n]) for n in ("s", "e", "k_s", "k_e", "breaks", "k_breaks"))
        shingles, k_shingles = (shingle_hashes(x.view(np.uint32).astype(np.uint64), words) for x in (w, k_w))
        seeds, at = _listed(ask["seeds"])
        of = np.repeat(np.arange(batch.num_rows), np.diff(at))
        a, b, ka, kb = (x.to_numpy().astype(np.int64) for x in seeds.flatten())
        order = np.lexsort((kb, ka, b, a, of))
        of, a, b, ka, kb = (x[order] for x in (of, a, b, ka, kb))
        # a repeat inside one text: neither side grows over the middle between them, each seed by itself
        own, middle = (rid == k_rid)[of], (kb + a) // 2
        first = np.where(own, s.find(of, middle), 0)
        last = np.where(own, k_e.find(of, middle, "right"), np.diff(k_begin)[of])
        runs = np.stack([s.find(of, a) - first, s.find(of, b) - first, k_s.find(of, ka), k_s.find(of, kb)], axis=1)
        fits = (runs[:, 0] >= 0) & (runs[:, 3] <= last)
        group = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | own[1:]])[: len(of)])
        out: list[tuple[int, int, int, int, int]] = []
        for i, j in zip(group.tolist(), [*group[1:].tolist(), len(of)], strict=True):
            row, skip = int(of[i]), int(first[i])
            x, y = int(begin[row]) + skip, int(begin[row + 1])
            k_x, k_y = int(k_begin[row]), int(k_begin[row]) + int(last[i])
            hs, gs = shingles[x : max(x, y - words + 1)].tolist(), k_shingles[k_x : max(k_x, k_y - words + 1)].tolist()
            for p, q, kp, kq in _grown(w[x:y], k_w[k_x:k_y], hs, gs, runs[i:j][fits[i:j]].tolist(), words, threshold):
                if q - p >= passage and kq - kp >= passage:
                    out.append((row, p + skip, q + skip, kp, kq))
        r, p, q, kp, kq = np.array(out, np.int64).reshape(-1, 5).T
        start, k_start = s.take(r, p), k_s.take(r, kp)
        line, k_line = (cols[n].to_numpy()[r] + x.find(r, at) for n, x, at in (("line", breaks, start), ("k_line", k_breaks, k_start)))
        doc_id, k_doc, n = (ask[c].to_numpy()[r] for c in ("doc_id", "k_doc", "n"))
        found = (rid[r], doc_id, start, e.take(r, q - 1), line, q - p, k_rid[r], k_doc, k_start, k_e.take(r, kq - 1), k_line, kq - kp, n)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names=names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield grown(batch.slice(at, TOGETHER))

    return grow


def repeated_passages(
    rows_of: DataFrame, texts: DataFrame, lines: DataFrame, passage: int = 20, words: int = 5, threshold: float = 0.8, gap: int = 512, edge: int = 48, spread: int = 32
) -> DataFrame:
    """What repeats in texts (rows of _FIELDS) outside the repeated lines(rid, paragraph, kept), in the columns of repeated_paragraphs().

    A piece that occurs twice or more is compared with its first occurrence that no removed line holds. Pieces that follow each other in both
    texts, up to `gap` characters apart, form a chain. Its words and `edge` words on either side (equal words beyond a piece
    end within the next) are read from both texts and grown by _grown(): stretches of `passage` words or more whose shingles have a Jaccard
    similarity of threshold or more are rows, of exactly the words that repeat. What lies in another row of its text isn't listed again.
    Requests for a kept stretch are spread over `spread` keys, so that a passage of very many texts is no single task.
    """
    every = texts.select("rid", F.posexplode("keys").alias("i", "key"))
    again = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "again")
    hits = every.join(again, "key").groupBy("rid").agg(F.array_distinct(F.collect_list(F.struct("i", "key", "n"))).alias("hits"))  # lists of one text each
    stays = lines.groupBy("rid", "paragraph").agg(F.max("kept").alias("stays")).groupBy("rid")
    stays = stays.agg(F.map_from_entries(F.collect_list(F.struct("paragraph", "stays"))).alias("stays"))
    place = lambda name: lambda h: F.get(name, h["i"])
    held = {"start": "starts", "end": "ends", "first": "firsts", "last": "lasts"}
    each = F.transform("hits", lambda h: F.struct(h["key"].alias("key"), h["n"].alias("n"), *[place(v)(h).alias(k) for k, v in held.items()]))
    some = texts.select("rid", "doc_id", *held.values()).join(hits, "rid").join(stays, "rid", "left").select("rid", "doc_id", "stays", F.inline(each))
    first, last = F.try_element_at("stays", "first"), F.try_element_at("stays", "last")
    covered = first.isNotNull() & last.isNotNull()
    goes = ~F.coalesce(first, F.lit(True)) | ~F.coalesce(last, F.lit(True))
    some = cut(some.select("rid", "doc_id", "key", "n", "start", "end", covered.alias("covered"), goes.alias("goes")), "some")
    for done in (again, texts):
        drop(done)
    keep = some.groupBy("key").agg(F.min(F.struct("goes", "doc_id", "start", "end", "rid")).alias("keep"))
    pairs = some.filter("NOT covered").join(keep, "key").filter("(keep.doc_id, keep.start) < (doc_id, start)")
    pairs = pairs.select("rid", "doc_id", "n", "start", "end", F.col("keep.rid").alias("k_rid"), F.col("keep.doc_id").alias("k_doc"), F.col("keep.start").alias("k_start"), F.col("keep.end").alias("k_end"))
    order = Window.partitionBy("rid", "k_rid").orderBy("start", "k_start")
    follows = (F.col("start") - F.lag("end").over(order)).between(0, gap) & (F.col("k_start") - F.lag("k_end").over(order)).between(0, gap)
    pairs = pairs.repartition("rid", "k_rid").distinct()  # one move serves this, the window and the chains
    chains = pairs.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("chain", F.sum("new").over(order))
    chains = chains.groupBy("rid", "doc_id", "k_rid", "k_doc", "chain").agg(
        F.min("start").alias("lo"), F.max("end").alias("hi"), F.min("k_start").alias("k_lo"), F.max("k_end").alias("k_hi"), F.min("n").alias("n"),
        F.collect_list(F.struct("start", "end", "k_start", "k_end")).alias("seeds"),
    )
    kid = F.xxhash64("k_rid", "k_lo", "k_hi", F.pmod(F.xxhash64(F.lit(3), "rid"), F.lit(spread)))
    chains = cut(chains.withColumn("kid", kid), "chains")
    drop(some)
    found = F.struct("kid", "lo", "hi", "doc_id", "k_rid", "k_doc", "n", "seeds").cast(_ASK).alias("ask")
    none = [F.lit(None).alias(n) for n in ("doc_id", "k_rid", "k_doc", "n", "seeds")]
    kept_of = chains.select(F.col("k_rid").alias("rid"), F.struct("kid", F.col("k_lo").alias("lo"), F.col("k_hi").alias("hi"), *none).cast(_ASK).alias("ask")).dropDuplicates(["rid", "ask"])
    need = cut(chains.select("rid", found).unionByName(kept_of).groupBy("rid").agg(F.collect_list("ask").alias("asks")), "asks")
    windows = rows_of.join(need, "rid").select("rid", "text", "asks").mapInArrow(_windows(edge), f"rid long, ask {_ASK}, {_WINDOW}")
    windows = cut(windows, "windows")
    for done in (chains, need):
        drop(done)
    kept_words = windows.filter("ask.doc_id IS NULL").select(F.col("ask.kid").alias("kid"), *[F.col(c).alias("k_" + c) for c in ("w", "s", "e", "breaks", "line")]).repartition("kid").dropDuplicates(["kid"])  # few repeat: no sort before the move
    grown = windows.filter("ask.doc_id IS NOT NULL").withColumn("kid", F.col("ask.kid")).join(kept_words, "kid").drop("kid").mapInArrow(_grow(words, threshold, passage), _GROWN)
    grown = cut(grown.distinct(), "grown")
    drop(windows)
    gone = grown.select(
        "rid", "doc_id", "paragraph", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n_words",
        F.col("k_doc").alias("keep_doc_id"), F.col("k_paragraph").alias("keep_paragraph"), F.col("n").alias("n_repeats"), F.lit(False).alias("kept"),
    )
    held_by = grown.groupBy("k_rid", "k_doc", "k_start", "k_end", "k_paragraph", "k_words").agg(F.max("n").alias("n"))
    stay = held_by.select(
        F.col("k_rid").alias("rid"), F.col("k_doc").alias("doc_id"), F.col("k_paragraph").alias("paragraph"), F.col("k_start").cast("long").alias("start"),
        F.col("k_end").cast("long").alias("end"), F.col("k_words").alias("n_words"), F.col("k_doc").alias("keep_doc_id"), F.col("k_paragraph").alias("keep_paragraph"),
        F.col("n").alias("n_repeats"), F.lit(True).alias("kept"),
    )
    text = Window.partitionBy("rid", "kept")
    before = text.orderBy("start", F.desc("end"), "keep_doc_id", "keep_paragraph").rowsBetween(Window.unboundedPreceding, -1)
    out = gone.unionByName(stay).withColumn("_in", F.max("end").over(before) >= F.col("end")).filter("NOT coalesce(_in, false)").drop("_in")
    # a stretch that stays for others but goes itself is no stretch that stays
    gone_at = lambda c: F.when(~F.col("kept"), F.col(c))
    upto = Window.partitionBy("rid").orderBy("start", "kept").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kept")).rowsBetween(Window.unboundedPreceding, -1)
    met = (F.max(gone_at("end")).over(upto) > F.col("start")) | (F.min(gone_at("start")).over(after) < F.col("end"))
    return out.withColumn("_met", F.coalesce(met, F.lit(False))).filter("NOT (kept AND _met)").drop("_met", "rid")


def _linked(sets: list[np.ndarray], threshold: float, side: np.ndarray, across: bool) -> np.ndarray:
    """Each set's smallest member of its component under exact Jaccard >= threshold.

    Breadth first: a set that is reached is only compared with those that aren't yet, so a bucket of one
    family takes about one comparison for each member.
    """
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    root, mark = np.full(len(sets), -1), np.zeros(codes.max() + 1, bool)
    free = np.arange(len(sets))
    while len(free):
        seed, free = free[0], free[1:]
        root[seed], todo = seed, deque([seed])
        while todo and len(free):
            i = todo.popleft()
            mine = codes[starts[i] : ends[i]]
            mark[mine] = True
            near = (sizes[free] >= threshold * sizes[i]) & (sizes[free] <= sizes[i] / threshold)
            if across:
                near &= side[free] != side[i]
            ask = free[near]
            if len(ask):
                n = sizes[ask]
                first = np.cumsum(n) - n
                at = np.arange(n.sum()) + np.repeat(starts[ask] - first, n)
                both = np.add.reduceat(mark[codes[at]].astype(np.int64), first)
                hit = ask[both >= threshold * (n + sizes[i] - both) - 1e-9]
                root[hit] = seed
                todo.extend(hit.tolist())
                free = free[root[free] < 0]
            mark[mine] = False
    return root


def _shingle_sets(words: int):
    """For rows (text, need): the sorted shingles of each needed line whose words have the keys that it is known by."""

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need, at = _listed(batch.column(1))
            field = {f.name: c.to_numpy() for f, c in zip(need.type, need.flatten(), strict=True)}
            for asked, text, _, starts, _ends, hashes, _doc, breaks, begin in _batches_of(batch.column(0).to_pylist(), at):
                base = np.searchsorted(breaks, begin)
                line, number = np.searchsorted(breaks, starts), base[text] + field["paragraph"][asked]
                first, count = np.searchsorted(line, number), np.searchsorted(line, number, "right")
                count -= first
                some = (number < np.append(base[1:], len(breaks) + 1)[text]) & (count >= words)
                asked, first, count = asked[some], first[some], count[some]
                inside, edge = _ranges(first, count)
                k1, k2 = line_keys(hashes[inside], edge)
                same = (k1 == field["k1"][asked]) & (k2 == field["k2"][asked])
                asked, first, count = asked[same], first[same], count[same] - words + 1
                inside, edge = _ranges(first, count)
                flat = shingle_hashes(hashes, words)[inside]
                for a, n in zip(edge.tolist(), count.tolist(), strict=True):
                    flat[a : a + n].sort()
                new = np.ones(len(flat), bool)
                new[1:] = flat[1:] != flat[:-1]
                new[edge] = True
                ends = np.concatenate([[0], np.cumsum(new)])[np.append(edge, len(flat))].astype(np.int32) * 8
                sets = pa.Array.from_buffers(pa.binary(), len(asked), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat[new].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(field["id"][asked], pa.int64()), sets], names=["id", "shingles"])

    return fetched


def repeated_paragraphs(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, least: int = 20, bands: int = 12, rows: int = 3, cap: int = 8192, reach: int = 4
) -> DataFrame:
    """Paragraphs of docs(doc_id, text) that repeat: doc_id, paragraph, start, end, n_words, keep_doc_id, keep_paragraph, n_repeats, kept.

    One row for each occurrence whose class has at least two. Classes are the components of the links between
    paragraphs of at least `least` words whose sets of word shingles have a Jaccard similarity of at
    least threshold; equal words always link. The occurrence with the smallest (doc_id, paragraph) stays, the
    others are to be removed at [start, end), code points of the text. With the defaults two paragraphs
    at the threshold share a band with a probability over 0.999.

    Passages of `least` words or more that repeat, equally or nearly, inside other lines or over line breaks follow as rows of their own
    (repeated_passages()), with the lines they begin in as paragraphs; what lies in repeated lines isn't listed again. Each goes in favour of an
    earlier (doc_id, start), the keep_doc_id of that row, which may go itself in favour of a still earlier one: the first always stays.
    Rows of one text may overlap where it repeats parts of several; n_repeats is the number of occurrences of its rarest equal piece.

    Words are lower-cased and parted by white space. Null and empty texts and rows without an id have no
    paragraphs. Rows that repeat an id and text repeat their paragraphs. Empty table: no rows.
    """
    rows_of = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, doc_id, text = (c.to_pylist() for c in batch.columns)
            yield from _cut_texts(doc_id, rid, text, words, least, bands, rows, reach)

    texts = cut(rows_of.mapInArrow(cut_up, _FIELDS), "paragraphs")
    found = texts.select("rid", "doc_id", F.inline("lines"))
    distinct = found.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "paragraph", "rid")).alias("at"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    banded = distinct.select("id", F.explode("bands").alias("band"))
    ident = F.xxhash64(F.lit(9), "id")
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(ident).alias("x"), F.min(ident).alias("low")).filter("n > 1")
    shared = cut(shared.groupBy("n", "x", "low").agg(F.min("band").alias("band")).select("band"), "shared")  # of bands with the same members one
    asked = cut(banded.join(shared, "band"), "asked")
    need = distinct.join(asked.select("id").distinct(), "id").groupBy(F.col("at.rid").alias("rid"))
    need = cut(need.agg(F.collect_list(F.struct(F.col("at.paragraph").alias("paragraph"), "id", "k1", "k2")).alias("need")), "need")

    again = rows_of.join(need, "rid").select("text", "need").mapInArrow(_shingle_sets(words), "id long, shingles binary")
    again = cut(again.repartition("id").groupBy("id").agg(F.first("shingles").alias("shingles")).withColumn("bytes", F.octet_length("shingles")), "shingles")

    def verified(t: pa.Table) -> pa.Table | None:
        if t.num_rows < 2:
            return None
        across = t.column("bi")[0].as_py() != t.column("bj")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()]
        root, ids = _linked(sets, threshold, t.column("side").to_numpy(), across), t.column("id").to_numpy()
        hit = root != np.arange(len(root))
        return pa.table({"a": ids[hit], "b": ids[root[hit]]}) if hit.any() else None

    pairs = map_groups(block_pairs(asked.join(again, "id"), "band", "id", cap, "bytes"), ["band", "bi", "bj"], verified, "a long, b long")
    parts = connected_components(pairs)
    classes = distinct.join(parts, "id", "left").select("k1", "k2", "at", "n", F.coalesce("component_id", "id").alias("c"))
    classes = cut(classes, "classes")
    total = classes.groupBy("c").agg(F.min("at").alias("keep"), F.sum("n").alias("n_repeats")).filter("n_repeats > 1")
    repeats = classes.join(total, "c").select("k1", "k2", "keep", "n_repeats")
    out = found.drop("bands").join(repeats, ["k1", "k2"])
    out = out.select(
        "rid", "doc_id", "paragraph", "start", "end", "n_words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.paragraph").alias("keep_paragraph"),
        "n_repeats", ((F.col("rid") == F.col("keep.rid")) & (F.col("paragraph") == F.col("keep.paragraph"))).alias("kept"),
    )
    out = cut(out, "repeated")
    for done in (distinct, shared, asked, need, again, classes):
        drop(done)
    return out.drop("rid").unionByName(repeated_passages(rows_of, texts, out, least, words, threshold))
