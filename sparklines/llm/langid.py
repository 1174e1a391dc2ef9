"""Language identification: TF-IDF vectors of letter n-grams against several clustered centroids for each language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklines.llm.common import cut, drop, unit_draw

UNKNOWN = "und"
PIECE = 1 << 20
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Odd multipliers of the n-gram hash (golden-ratio and Knuth constants).
_M = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str, dim: int) -> np.ndarray:
    """Hashed counts of the text's 1- to 4-grams of UTF-8 bytes, lower-cased, with one space for what isn't a letter."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    out = np.zeros(dim, np.int64)
    for at in range(0, len(raw), PIECE):
        a = np.frombuffer(raw[at : at + PIECE + 3], np.uint8).astype(np.uint32) + np.uint32(1)
        h, grams = np.zeros(len(a), np.uint32), []
        for n in range(min(4, len(a))):
            h = (h[: len(a) - n] ^ (a[n:] * _M[n])) * np.uint32(0x9E3779B1)
            grams.append(h[:PIECE] >> np.uint32(15))
        out += np.bincount(np.concatenate(grams) % np.uint32(dim), minlength=dim)
    return out


def tf_vectors(texts: list[str | None], dim: int) -> np.ndarray:
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        if t:
            out[i] = counts(t, dim)
    return np.log1p(out, out=out)


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds: at most k unit centroids of unit rows."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = _normal(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    reject: float
    floor: np.ndarray

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Least cosine of a recognised text, by its number of different n-grams: the floor between its points."""
        at = np.log2(np.maximum(np.count_nonzero(x, axis=1), 1))
        return np.maximum(self.reject, np.interp(at, np.arange(len(self.floor)), self.floor))

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score (cosine to the nearest centroid, 0 to 1), rejected."""
        lettered = np.array([has_letter(t) for t in texts], bool)
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        bound = np.zeros(len(texts))
        for a in range(0, len(texts), 256):
            x = _normal(tf_vectors(texts[a : a + 256], len(self.idf)) * self.idf)
            if len(self.langs):
                cos = x @ self.centroids.T
                best = np.argmax(cos, axis=1)
                bound[a : a + 256] = self.bound(x)
                lang[a : a + 256] = np.array(self.langs, object)[self.owner[best]]
                score[a : a + 256] = np.clip(cos[np.arange(len(x)), best], 0, 1)
        lang[~lettered], score[~lettered] = UNKNOWN, 0.0
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": ~lettered | (score < bound)})


def starts_of(text: str) -> list[str]:
    """The text's first 1, 2, 4, ... words, up to 256."""
    words = text[:4096].split()[:256]
    return [" ".join(words[: 1 << k]) for k in range(9) if 1 << k <= len(words)]


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the ids, never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = 400, dim: int = 4096, clusters: int = 4, reject: float = 0.03, low: float = 0.01, margin: float = 0.8) -> LanguageModel:
    """Fit on labelled rows of docs(doc_id, text, lang) that are not held out.

    At most 2 x per_language rows for each label, about per_language as a rule, drawn by the hash of the id: the documented bound of
    what is learned from. Every label is learned; a label's rows are clustered in one task, and the driver receives
    document frequencies, centroids and the rejection bounds, dim numbers for each cluster of a label. Rows without
    letters teach nothing. No labelled rows: a model that knows no language. How near a text must be to be recognised
    is learned from the cosines of the same rows and their first words, by the number of different n-grams: margin times
    their low quantile near each power of two, where 20 or more are; never under reject.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(per_language) / F.col("_n")
    drawn = known.withColumn("_u", unit_draw("language", F.col("doc_id"))).join(F.broadcast(sizes), "lang").filter(F.col("_u") < share)  # a row for each label
    few = 2000 * 2**32  # starts come from about 2000 learned rows, whatever the number of labels

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keep = [i for i, t in enumerate(p["text"]) if has_letter(t)]
            texts = [p["text"].iloc[i] for i in keep]
            x = [v.tobytes() for v in tf_vectors(texts, dim).astype(np.float16)]
            own = p.iloc[keep]
            yield pd.DataFrame({"lang": own["lang"], "u": own["_u"], "vec": x, "order": [crc32(v) for v in x], "starts": [starts_of(t) for t in texts]})

    rows = drawn.mapInPandas(vectors, "lang string, u double, vec binary, order long, starts array<string>")
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "order", "vec"))).filter(F.col("_k") <= 2 * per_language)
    rows = cut(rows, "learned")
    none = LanguageModel((), np.zeros((0, dim), np.float32), np.zeros(0, int), np.ones(dim, np.float32), reject, np.zeros(1))

    def frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, np.zeros(dim, np.int64)
        for p in parts:
            n += len(p)
            for v in p["vec"]:
                df += np.frombuffer(v, np.float16) > 0
        if n:
            yield pd.DataFrame({"at": np.arange(-1, dim), "n": np.concatenate([[n], df])})

    counted = rows.mapInPandas(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return none
    df = np.zeros(dim + 1, np.int64)
    df[[r["at"] + 1 for r in counted]] = [r["n"] for r in counted]
    total, idf = int(df[0]), (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    def clustered(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["u", "order", "vec"])
        x = _normal(np.stack([np.frombuffer(v, np.float16) for v in p["vec"]]).astype(np.float32) * idf)
        return pd.DataFrame({"lang": p["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in cluster(x, clusters)]})

    found = rows.groupBy("lang").applyInPandas(clustered, "lang string, centroid binary").collect()
    by = {}
    for r in found:
        by.setdefault(r["lang"], []).append(np.frombuffer(r["centroid"], np.float32))
    langs = tuple(sorted(by))
    centroids, owner = np.stack([c for lang in langs for c in by[lang]]), np.repeat(np.arange(len(langs)), [len(by[lang]) for lang in langs])
    shared = docs.sparkSession.sparkContext.broadcast((centroids, idf))

    def cosines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, idf = shared.value
        for p in parts:
            x = [_normal(np.stack([np.frombuffer(v, np.float16) for v in p["vec"]]).astype(np.float32) * idf)]
            begun = [t for o, texts in zip(p["order"], p["starts"], strict=True) if o < few / total for t in texts if has_letter(t)]
            x += [_normal(tf_vectors(begun[a : a + 256], dim) * idf) for a in range(0, len(begun), 256)]
            for v in x:
                at = np.round(np.log2(np.maximum(np.count_nonzero(v, axis=1), 1))).astype(int)
                yield pd.DataFrame({"at": at, "cos": (v @ centroids.T).max(axis=1).astype(float)})

    points = rows.mapInPandas(cosines, "at int, cos double").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.percentile("cos", low).alias("q")).collect()
    floor = np.full(int(np.log2(dim)) + 1, np.nan)
    for r in points:
        if r["n"] >= 20:
            floor[r["at"]] = margin * r["q"]
    sure = np.flatnonzero(~np.isnan(floor))
    floor = np.interp(np.arange(len(floor)), sure, floor[sure], left=0.0) if len(sure) else np.zeros(len(floor))
    drop(rows)
    return LanguageModel(langs, centroids, owner, idf, reject, floor)


def predicted(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Column struct(lang_pred, score, rejected) of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages vectors

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict([t if isinstance(t, str) else None for t in texts])

    return identify(F.col(text))


def identify_languages(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs(doc_id, text, lang).

    lang_pred is the label of the nearest centroid by cosine (ties: the first in order of label), `und` for
    texts that are null or have no letter. rejected: `und`, or farther from every centroid than the model's
    bound allows. A null id is not held out. options: those of train(). Empty table: no rows.
    """
    model = train(docs, **options)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predicted(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
