"""From documents to encoded training text, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklines.llm.common import cut, drop, parted
from sparklines.llm.components import connected_components
from sparklines.llm.exact_dedup import kept_rows
from sparklines.llm.langid import predicted, train
from sparklines.llm.mixing import mix_sources
from sparklines.llm.sentencepiece_codec import encode_documents
from sparklines.llm.simhash import link_near_texts
from sparklines.llm.similar_texts import similar_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or far from every centroid go."""
    docs = docs.select(*COLUMNS)
    model = train(docs)
    return docs.withColumn("_p", predicted(docs, model)).filter(~F.col("_p.rejected")).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id."""
    return kept_rows(docs, COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows without an id stay.

    Near are fingerprints as in op4, and texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    docs = docs.select(*COLUMNS)
    close = link_near_texts(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    links = similar_texts(docs)
    parts = connected_components(close.unionByName(links))
    goes = cut(parts.filter("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "goes")
    drop(links)
    some, rest = parted(docs, "doc_id", goes, goes.count())
    return rest.unionByName(some.join(goes, "doc_id", "left_anti"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    taken = mix_sources(docs, columns=COLUMNS[1:])
    again = F.expr("explode(sequence(1, copies))")
    return taken.filter("copies > 0").select(*COLUMNS, again.alias("_k")).drop("_k")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, as digests of what the encoder writes and decodes."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mixed), ("encode", encoded)]

#: Language ID, the near-duplicate links and the encoder have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
