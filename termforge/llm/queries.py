"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cover_tree, langid, ngram, ngram_corpus, packing, passages, sentencepiece, simhash, substring_index, suffix_dedup, token_counts, topk

Query = Callable[[SparkSession, str], DataFrame]
LOOSE = 0.3
MODEL = os.environ.get("TERMFORGE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), MODEL)


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir), MODEL)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.repeats(documents(spark, sf_dir))


def op7_ngram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_corpus.score_corpus(documents(spark, sf_dir))


def op7_benchmark_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_embedding_near_duplicates at a threshold that unrelated vectors reach, so that small tables have links too."""
    return cover_tree.near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), LOOSE)


def op9_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs behind op9_embedding_links."""
    return cover_tree.near_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), LOOSE)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_COSINE = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
_VECTORS = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

_PAIRS = f"""{_VECTORS}, p AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round({_COSINE}, 10) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)"""


def op9_sql(threshold: float) -> str:
    return f"""{_PAIRS.replace("WITH", "WITH RECURSIVE", 1)}, l AS (SELECT vec_a AS a, vec_b AS b FROM p WHERE s >= {threshold} UNION ALL SELECT vec_b, vec_a FROM p WHERE s >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.a AS vec_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN n ON c.a = n.a"""


OP9_PAIRS_SQL = f"""{_PAIRS} SELECT vec_a, vec_b, round(s, 6) AS similarity FROM p WHERE s >= {LOOSE}"""

OP10_SQL = f"""{_VECTORS}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, round({_COSINE}, 10) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS k FROM p)
SELECT query_id, CAST(k AS INTEGER) AS rank, neighbour_id, round(s, 6) AS similarity FROM r WHERE k <= 10"""


def queries() -> dict[str, Query]:
    ops = (op1_token_counts, op2_simhash_near_duplicates, op3_language_id, op4_sentencepiece, op5_packing, op6_substring_index, op7_ngram_scoring, op7_benchmark_scoring, op8_suffix_array_dedup, op9_embedding_near_duplicates, op9_embedding_links, op9_embedding_pairs, op10_exact_top_k)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_index": passages.ORACLE_SQL, "op8_suffix_array_dedup": passages.ORACLE_SQL, "op9_embedding_near_duplicates": op9_sql(cover_tree.SIMILARITY), "op9_embedding_links": op9_sql(LOOSE), "op9_embedding_pairs": OP9_PAIRS_SQL, "op10_exact_top_k": OP10_SQL}
