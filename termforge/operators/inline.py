"""Definitions in running text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import Profile, java

CONFIDENCE = 0.65


def _match(k: int) -> Callable[[Column, Column], Column]:
    return lambda m, no: F.struct(F.lit(k).alias("pattern"), no.alias("no"), m["term"].alias("term"), m["definition"].alias("definition"))


def inline_matches(pages: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, page_idx, label, pattern, no, page_text, term, definition): every match of every pattern, case as written."""
    fixed = pages.withColumn("page_text", T.fix_ocr_spacing(F.col("text"))).where(F.length("page_text") >= T.MIN_INLINE_PAGE)
    found = []
    for k, pattern in enumerate(profile.inline):
        own = F.lit(java(pattern, "m"))
        both = F.arrays_zip(F.regexp_extract_all("page_text", own, F.lit(1)).alias("term"), F.regexp_extract_all("page_text", own, F.lit(2)).alias("definition"))
        found.append(F.transform(both, _match(k)))
    # The matches of all patterns in one pass over the pages.
    every = fixed.select("doc_id", "page_idx", "label", "page_text", F.explode(F.flatten(F.array(*found))).alias("m"))
    return every.select("doc_id", "page_idx", "label", "m.pattern", "m.no", "page_text", "m.term", "m.definition")


def inline_entries(pages: DataFrame, profile: Profile, unicode_form: bool = True) -> DataFrame:
    """Entries in the shape of the output schema; length and gibberish are judged before citations are cut."""
    found = inline_matches(pages, profile).withColumn("term", T.clean_inline_term(F.col("term"))).withColumn("raw", T.strip(F.col("definition")))
    kept = found.where((F.col("term") != "") & F.length("raw").between(T.MIN_INLINE, T.MAX_INLINE) & ~T.is_gibberish(F.col("raw")))
    return kept.select(
        "doc_id",
        F.struct(F.lit(1).alias("source"), F.col("page_idx").cast("int").alias("page"), F.col("pattern").cast("int").alias("pattern"), F.col("no").cast("int").alias("no")).alias("seq"),
        "term",
        T.normalize_term(F.col("term"), unicode_form).alias("term_normalized"),
        T.strip_citations(F.col("raw"), profile.citation).alias("definition"),
        F.lit("inline").alias("source_type"),
        T.guess_section(F.col("page_text")).alias("section"),
        (F.col("page_idx") + 1).cast("int").alias("pdf_page_index"),
        F.col("label").alias("printed_page_label"),
        F.lit(CONFIDENCE).alias("confidence"),
        F.array(F.lit(T.INLINE_FLAG)).alias("flags"),
    )
