"""Collocations by dynamic itemset counting: phrases of several lengths are counted in the same cyclic scans over shards.

The corpus is dealt over shards, which are scanned in turn, over and over. Words are counted from the first step on. A longer phrase
becomes active once both phrases it is made of (all but its last word, all but its first) have reached the threshold in the counts so far; it is
counted from the next step on, for one full cycle, so each shard counts it once. A phrase whose parts never
reach the threshold is never counted; it can't reach the threshold itself. The scans end when nothing is left in progress, after three
cycles at most for phrases of three words. A last cycle takes down the frequent phrases as they are written.

Which parts have reached the threshold is told to the tasks by tables of a fixed number of slots: a slot holds the step in which the first
phrase hashed to it did so. Two phrases in a slot only mean that some phrases are counted in vain or from an earlier step on, always
the same one, for slots never change once set.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklines.llm.common import cut, drop
from sparklines.llm.words import mixed

#: Words counted together before their counts leave the task, and words in a row of hashes: Parquet's pages hold 100 rows or more.
CHUNK, ROW = 1 << 20, 1 << 13
#: Bytes that end a piece become line feeds.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r", b"\n" * 9)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: A slot nobody has set.
NEVER = 255


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of each piece, with A-Z in lower case."""
    for piece in text.lower().translate(_ENDS).split(b"\n"):
        if words := piece.split():
            yield words


class _Words:
    """Words of some texts by their hashes, piece after piece; words of different languages have different hashes."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.hashes = hashes
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(hashes))  # words from each place to the end of its piece

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, hashes of the phrases of n words there) for each length."""
        places, hashes = np.arange(len(self.hashes)), self.hashes
        for n in range(1, longest + 1):
            if n > 1:
                fits = self.left[places] >= n
                places = places[fits]
                hashes = mixed(hashes[fits] * _GOLD + self.hashes[places + n - 1])
            yield n, places, hashes

    def counts(self, step: int, shards: int, longest: int, active: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, hashes, counts) of the phrases that are due in this step."""
        since = np.zeros(0)
        for n, places, hashes in self.phrases(longest):
            if n == 1:
                due = hashes if step < shards else hashes[:0]
            else:
                begun = np.maximum(since[places], since[places + 1])
                due = hashes[(begun < step) & (step <= begun + shards)]
            if len(due):
                yield n, *np.unique(due, return_counts=True)
            if n == longest or (active[n - 1] == NEVER).all():
                return
            since = np.full(len(self.hashes), NEVER, np.int16)  # steps in which the phrases that begin at each place reached the threshold
            since[places] = active[n - 1][hashes & np.uint64(len(active[n - 1]) - 1)]


class _Chunk:
    """Some texts as numbered words; words of different languages have different numbers."""

    def __init__(self):
        self.fresh = count()
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.ids: list[int] = []
        self.sizes: list[int] = []

    def add(self, lang: str, text: bytes) -> None:
        number = self.numbers.setdefault(lang, defaultdict(self.fresh.__next__))
        for words in pieces(text):
            self.ids.extend(map(number.__getitem__, words))
            self.sizes.append(len(words))

    def close(self) -> _Words:
        """All texts are here: the words by their hashes, and what the numbers stand for."""
        self.at = np.array(self.ids, np.int64)
        total = sum(map(len, self.numbers.values()))
        self.names, self.langs, keys = [b""] * total, [""] * total, np.zeros(total, np.uint64)
        for lang, of in self.numbers.items():
            head = lang.encode("utf-8", "surrogatepass") + b"\t"
            for word, number in of.items():
                self.names[number], self.langs[number], keys[number] = word, lang, xxhash.xxh64_intdigest(head + word)
        return _Words(keys[self.at], np.array(self.sizes, np.int64))

    def named(self, frequent: list[np.ndarray]) -> Iterator[tuple[int, list[str], list[bytes], np.ndarray]]:
        """(n, languages, phrases, counts) of the phrases whose slots are set; of length 0 all words of each language."""
        words = self.close()
        every = np.bincount(self.at, minlength=len(self.names))
        yield 0, list(self.numbers), [b""] * len(self.numbers), np.array([every[list(of.values())].sum() for of in self.numbers.values()], np.int64)
        bits = max(1, (len(self.names) - 1).bit_length())
        for n, places, hashes in words.phrases(len(frequent)):
            at = places[frequent[n - 1][hashes & np.uint64(len(frequent[n - 1]) - 1)]]
            if n * bits < 64:
                packed = self.at[at]
                for k in range(1, n):
                    packed = packed << bits | self.at[at + k]
                packed, times = np.unique(packed, return_counts=True)
                parts = [packed >> bits * (n - 1 - k) & (1 << bits) - 1 for k in range(n)]
            else:
                distinct, times = np.unique(np.stack([self.at[at + k] for k in range(n)], axis=1), axis=0, return_counts=True)
                parts = list(distinct.T)
            phrases = list(map(b" ".join, zip(*([self.names[i] for i in part.tolist()] for part in parts), strict=True)))
            yield n, [self.langs[i] for i in parts[0].tolist()], phrases, times


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, hashes, sizes) of texts(lang, text, shard): the words of many texts of a shard in a row."""
    held: dict[int, _Chunk] = {}

    def rows(shard: int) -> Iterator[pa.RecordBatch]:
        words, sizes = held[shard].close().hashes, np.array(held.pop(shard).sizes, np.int32)
        ends = np.cumsum(sizes)
        parts = np.unique(np.searchsorted(ends, np.append(np.arange(ROW, len(words), ROW), len(words))) + 1) if len(words) else []
        for a, b in zip([0, *parts[:-1]], parts, strict=True):
            own = words[ends[a] - sizes[a] : ends[b - 1]]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "hashes": [own.tobytes()], "sizes": [sizes[a:b].tobytes()]})

    for batch in batches:
        for lang, text, shard in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            chunk = held.setdefault(shard, _Chunk())
            chunk.add(lang, text.as_py())
            if len(chunk.ids) > CHUNK >> 2:
                yield from rows(shard)
    for shard in list(held):
        yield from rows(shard)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """Rows of _hashed(), some at a time."""
    held, size = [], 0
    for batch in batches:
        for hashes, sizes in zip(batch.column(0), batch.column(1), strict=True):
            held.append((np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(sizes.as_py(), np.int32)))
            size += len(held[-1][0])
            if size > CHUNK:
                yield _Words(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield _Words(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _slots(keys: DataFrame, slots: int) -> dict[int, np.ndarray]:
    """By length, which slots the keys(words, key) fall into; a bitmap of slots / 8 bytes a length at most comes to the driver."""
    place = keys.select("words", (F.col("key").bitwiseAND(F.lit(slots - 1)) + 1).alias("at"))
    maps = place.groupBy("words", F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out: dict[int, np.ndarray] = {}
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        out[r.words] = out[r.words] if r.words in out else np.zeros(slots, bool)
        out[r.words][(r.part - 1) * len(bits) : r.part * len(bits)] = bits[: slots - (r.part - 1) * len(bits)]
    return out


def _summed(counts: DataFrame, *totals: Column) -> DataFrame:
    """Totals by (words, key). A task has a key once or hardly more often, so rows are dealt out before anything is added up."""
    return counts.repartition("words", "key").groupBy("words", "key").agg(*totals)


def _packed(tables: list[np.ndarray]) -> list[bytes]:
    return [zlib.compress(t.tobytes(), 1) for t in tables]


def count_phrases(docs: DataFrame, least: int = 10, longest: int = 3, shards: int = 2, slots: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """(frequent, totals): (lang, words, phrase, n) of all phrases of up to `longest` words that occur `least` times or more in docs(lang, text), and (lang, n) of all words.

    The steps count phrases by 64-bit hashes, which is enough to know which ones may be frequent: phrases of one hash only raise each other's
    counts. A last cycle counts the phrases in frequent slots as they are written, which makes the result exact.
    shards: parts of the corpus that are scanned in turn (at most 254 / longest); the steps read them as hashes of words, which are written once. slots: a power of two, a byte each in a task's tables; more of them
    prune better, the result stays the same. Tables travel compressed, so a small corpus sends little. Each step writes its counts to the shared folder.
    """
    spark = docs.sparkSession
    dealt = F.pmod(F.xxhash64(*[F.col(c) for c in ("doc_id", "text") if c in docs.columns]), F.lit(shards)).cast("int")
    text, lang = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    scan = docs.select(lang.alias("lang"), text.cast("binary").alias("text"), dealt.alias("shard"))
    corpus = cut(scan.mapInArrow(_hashed, "shard int, hashes binary, sizes binary"), "shards", by="shard")
    active = [np.full(slots, NEVER, np.uint8) for _ in range(longest - 1)]
    fresh: list[list[bool]] = [[] for _ in active]  # whether phrases of a length reached the threshold in each step
    grown, tops = None, []
    step = 0
    while step < shards or any(any(f[-shards:]) for f in fresh):
        shared = spark.sparkContext.broadcast(_packed(active))

        def counted(batches: Iterator[pa.RecordBatch], step: int = step, shared=shared) -> Iterator[pa.RecordBatch]:
            tables = [np.frombuffer(zlib.decompress(t), np.uint8) for t in shared.value]
            for words in _together(batches):
                for n, keys, times in words.counts(step, shards, longest, tables):
                    for a in range(0, len(keys), 1 << 16):
                        part = slice(a, a + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), n, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(times[part])], ["words", "key", "n"])

        found = corpus.filter(F.col("shard") == step % shards).select("hashes", "sizes").mapInArrow(counted, "words int, key long, n long")
        found = cut(_summed(found, F.sum("n").alias("n")), f"step{step}")
        tops.append(found.filter(F.col("words") == longest))
        new = {}
        if step < shards or any(any(f[-shards:]) for f in fresh[:-1]):  # else only the longest phrases are left in progress
            parts = found.filter(F.col("words") < longest).withColumn("since", F.lit(None).cast("int"))
            before = grown
            if before is not None:
                parts = _summed(before.unionByName(parts), F.sum("n").alias("n"), F.min("since").alias("since"))
            grown = cut(parts.withColumn("since", F.coalesce("since", F.when(F.col("n") >= least, F.lit(step)))), "counts")
            if before is not None:
                drop(before)
            new = _slots(grown.filter(F.col("since") == step), slots)
        for n, (table, seen) in enumerate(zip(active, fresh, strict=True), 1):
            seen.append(n in new)
            if n in new:
                table[new[n] & (table == NEVER)] = step
        shared.destroy()
        step += 1
    top = _summed(reduce(DataFrame.unionByName, tops), F.sum("n").alias("n"))
    set_ = _slots(top.filter(F.col("n") >= least), slots)
    tables = [t != NEVER for t in active] + [set_.get(longest, np.zeros(slots, bool))]
    last = spark.sparkContext.broadcast(_packed(tables))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, chunk = [np.frombuffer(zlib.decompress(t), bool) for t in last.value], _Chunk()

        def rows() -> Iterator[pa.RecordBatch]:
            for n, langs, phrases, times in chunk.named(frequent):
                for a in range(0, len(phrases), 1 << 15):
                    part = slice(a, a + (1 << 15))
                    cols = [pa.array(langs[part], pa.string()), pa.array(np.full(len(phrases[part]), n, np.int32)), pa.array(phrases[part], pa.binary()), pa.array(times[part])]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "words", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(lang, text.as_py())
                if len(chunk.ids) > CHUNK:
                    yield from rows()
                    chunk = _Chunk()
        if chunk.numbers:
            yield from rows()

    exact = scan.select("lang", "text").mapInArrow(named, "lang string, words int, phrase binary, n long").withColumn("phrase", F.col("phrase").cast("string"))
    exact = exact.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))
    exact = cut(exact, "frequent")
    last.destroy()
    for table in (corpus, grown, *tops):
        drop(table)
    return exact.filter("words > 0"), exact.filter("words = 0 AND n > 0").select("lang", "n")


def _run(words: Column, first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, inside: int = 50, shards: int = 2, slots: int = 1 << 23) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best collocations of docs(lang, text); other columns are ignored.

    Texts with A-Z in lower case are split into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs. A candidate is a phrase of 2 to `longest` words with
    a = f(phrase) >= least. Cut after k words it has l and r, the counts of both parts, and the score floor(10^6 a a / (l r)); the cut of
    the lowest score counts, of equal ones that with the smallest k. Arithmetic is in decimals of 38 digits. A candidate goes if it stands inside a longer one that
    occurs at least `inside` percent as often. n counts all words of the language.

    A null language is `und`, a null text has no words; so do empty ones. Rows that repeat are counted as often as they stand there.
    Languages without candidates don't appear; empty tables give empty results. Ties rank by a, then by the phrase's bytes.
    """
    frequent, totals = count_phrases(docs, least, longest, shards, slots)
    words = F.split("phrase", " ")
    some = frequent.filter("words > 1").withColumn("w", words)
    cuts = some.select("lang", "words", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", _run(F.col("w"), 1, F.col("k")).alias("first"), _run(F.col("w"), F.col("k") + 1, F.col("words")).alias("rest"))
    left, right = (frequent.select("lang", F.col("phrase").alias(c), F.col("n").alias(x)) for c, x in (("first", "l"), ("rest", "r")))
    big = {c: F.col(c).cast("decimal(20,0)") for c in "alr"}
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumns({"up": big["a"] * big["a"] * F.lit(1_000_000), "down": big["l"] * big["r"]})
    best = cuts.withColumn("score", F.expr("up div down")).groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    within = some.filter("words > 2").select("lang", "n", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    within = within.select("lang", "n", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    within = within.groupBy("lang", _run(F.col("w"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("n").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    kept = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").cast("long").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(32)).alias("salt")
    first = kept.select("*", salt).withColumn("_r", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("_r") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order))
    ranked = first.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
