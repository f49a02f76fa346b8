"""One entry for each term of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe(entries: DataFrame) -> DataFrame:
    """The best entry for each (doc_id, term_normalized), with its place `ord` in the document.

    Glossary before inline, then the higher confidence (null is 0), then the earlier page, then the first met. A term's
    place is where it is met first, whichever entry wins. Entries without a key go.
    """
    same = Window.partitionBy("doc_id", "term_normalized")
    rank = (F.col("source_type") != "glossary", F.coalesce("confidence", F.lit(0.0)).desc(), F.col("pdf_page_index"), F.col("seq"))
    # By document once, which serves both windows.
    keyed = entries.where("term_normalized <> ''").repartition("doc_id")
    best = keyed.withColumn("rank", F.row_number().over(same.orderBy(*rank))).withColumn("first", F.min("seq").over(same)).where("rank = 1")
    return best.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("first"))).drop("rank", "first")
