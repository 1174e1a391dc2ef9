"""The registered queries of this subpackage and, where SQL can say the same, their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparklines.llm.collocations import collocations
from sparklines.llm.embedding_dedup import link_embeddings
from sparklines.llm.exact_dedup import exact_dedup
from sparklines.llm.langid import identify_languages
from sparklines.llm.mixing import mix_sources
from sparklines.llm.neighbours import nearest
from sparklines.llm.paragraph_dedup import repeated_paragraphs
from sparklines.llm.periodic_runs import find_runs
from sparklines.llm.pii import find_pii
from sparklines.llm.sentencepiece_codec import encode_documents
from sparklines.llm.sharding import shard_documents
from sparklines.llm.simhash import link_near_texts
from sparklines.llm.token_files import read_token_files, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(_table(spark, sf_dir, "embeddings"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_texts(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


SQL_OP7_EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


SQL_OP8_SOURCE_MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * sum(source_size) OVER ()
               - coalesce(sum(2.0::DOUBLE * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest_w
      FROM s WINDOW q AS (ORDER BY 2.0::DOUBLE * source_size / w, w, source IS NULL, source)),
f AS (SELECT *, cap * rest_w <= rest * w AS filled FROM o),
t AS (SELECT source, source_size,
             CASE WHEN filled THEN cap ELSE w * (first_value(rest) OVER z) / (first_value(rest_w) OVER z) END AS target
      FROM f WINDOW z AS (PARTITION BY filled ORDER BY rest_w DESC)),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate,
             ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + (draw < rate - floor(rate))::INT)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM c
"""


def op9_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


SQL_OP11_PHRASE_COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, k, phrase, a, 1 AS cut, w[1] AS x, CASE k WHEN 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS y FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT cuts.*, x.a AS l, y.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
e AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
  FROM b LEFT JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE e.longer IS NULL OR 100 * e.longer < 50 * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(_table(spark, sf_dir, "documents"), planted=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k.removeprefix("SQL_").lower(): v for k, v in globals().items() if k.startswith("SQL_")}
