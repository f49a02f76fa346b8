"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import langid, packing, simhash, suffix_dedup
from termforge.llm.common import fresh, row_keyed, small, written

# Compression, fingerprints and packing patterns are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the rejected go."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; different texts under one id are documents each; those without an id stay."""
    row, key = fresh(docs, "gone_row"), fresh(docs, "gone_doc")
    marked = row_keyed(docs, row, "doc_id", "text")
    gone = small(written(simhash.near_duplicates(marked, row).select(F.col("doc_id").alias(key)), "gone"))
    return marked.join(gone, F.col(row) == F.col(key), "left_anti").drop(row)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds."""
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows that the documents' pieces are put in."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", passage_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
