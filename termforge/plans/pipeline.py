"""The whole extraction as one plan: pages and spans in, a payload for each document out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import Profile, java
from ..operators import layout, ranges, segment
from ..operators.dedup import dedupe
from ..operators.inline import inline_entries
from ..sources.shared import stored

SCHEMA_VERSION, EXTRACTOR_VERSION = "1", "1.0.0"
MIN_BOLD_RATE = 0.10
ENTRY = ("term", "term_normalized", "definition", "source_type", "section", "pdf_page_index", "printed_page_label", "confidence", "flags")


def glossary(pages: DataFrame, spans: DataFrame, where: DataFrame, profile: Profile, unicode_form: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, (doc_id, fallback)) of the sectioned ranges.

    Where too few lines begin in bold, the gate by position alone is tried, for those documents only, and taken if it gives
    more entries.
    """
    inside = where.select(F.col("doc_id").alias("d"), "parse_start", "parse_end", "narrowing_fired")
    own = spans.join(inside, (F.col("doc_id") == F.col("d")) & F.col("page_idx").between(F.col("parse_start"), F.col("parse_end")), "left_semi")
    if profile.section_two is not None:
        firsts = where.where("narrowing_fired").select("doc_id", F.col("parse_start").alias("first_page"))
        own = layout.clip_above(own, java(profile.section_two, "im"), firsts)
    info = pages.select(F.col("doc_id").alias("d"), F.col("page_idx").alias("p"), "height", "label")
    lines = stored(layout.lines_of(own).join(info, (F.col("doc_id") == F.col("d")) & (F.col("page_idx") == F.col("p"))).drop("d", "p"), "lines")
    entries = stored(segment.glossary_entries(lines, profile, unicode_form=unicode_form), "entries")
    none = where.select("doc_id", F.lit(False).alias("fallback"))
    if not profile.bold_gate:
        return entries, none
    # A range without any line has rate 0 as well.
    rate = where.select("doc_id", "start", "end").join(layout.bold_rate(spans, where), "doc_id", "left").where(F.coalesce("bold_rate", F.lit(0.0)) < MIN_BOLD_RATE).select("doc_id")
    legacy = segment.glossary_entries(lines.join(rate, "doc_id", "left_semi"), profile, legacy=True, unicode_form=unicode_form)
    counts = legacy.groupBy("doc_id").agg(F.count("*").alias("n_legacy")).join(entries.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left")
    better = counts.where(F.col("n_legacy") > F.coalesce("n", F.lit(0))).select("doc_id")
    chosen = entries.join(better, "doc_id", "left_anti").unionByName(legacy.join(better, "doc_id", "left_semi"))
    return chosen, none.join(better.withColumn("yes", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("yes", F.lit(False)).alias("fallback"))


def extract(pages: DataFrame, spans: DataFrame, profile: Profile, unicode_form: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all entries before dedup, text layers, sectioned ranges, fallbacks). Documents without a text layer yield nothing."""
    pages, spans = stored(pages, "pages"), stored(spans, "spans")
    layers = ranges.text_layers(pages)
    readable = pages.join(layers.where("text_layer_present").select("doc_id"), "doc_id", "left_semi")
    where = stored(ranges.sections(readable, stored(ranges.glossary_ranges(readable, profile), "ranges"), profile), "sections")
    found, fallback = glossary(readable, spans, where, profile, unicode_form)
    return found.unionByName(inline_entries(readable, profile, unicode_form)), layers, where, fallback


def payloads(docs: DataFrame, pages: DataFrame, spans: DataFrame, profile: Profile, deterministic: bool = True) -> DataFrame:
    """A row for each of docs (doc_id, filename, gcs_key): the versioned output document.

    doc_id names a document within the plan; where docs have a column given_id, that is the id which goes out. deterministic leaves out the one field that depends on the time.
    """
    every, layers, where, fallback = extract(pages, spans, profile)
    every = stored(every, "found")
    counts = every.groupBy("doc_id").agg(F.count_if(F.col("source_type") == "glossary").alias("n_glossary"), F.count_if(F.col("source_type") == "inline").alias("n_inline"))
    entry = F.struct("ord", *ENTRY)
    best = dedupe(every).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*(e[n].alias(n) for n in ENTRY))).alias("entries"))
    out = docs.join(layers, "doc_id", "left").join(where, "doc_id", "left").join(fallback, "doc_id", "left").join(counts, "doc_id", "left").join(best, "doc_id", "left")
    none = F.array().cast(best.schema["entries"].dataType)
    publication = T.publication_number(F.element_at(F.split("filename", "/"), -1), profile)
    pages_of = lambda a, b: F.sequence(F.col(a) + 1, F.col(b) + 1)
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    metadata = F.struct(
        F.coalesce("total_pages", F.lit(0)).alias("total_pages"),
        F.when(F.col("start").isNotNull(), pages_of("start", "end")).otherwise(F.array().cast("array<int>")).alias("glossary_pages"),
        F.coalesce("text_layer_present", no).alias("text_layer_present"),
        F.coalesce("n_glossary", zero).alias("entries_glossary"),
        F.coalesce("n_inline", zero).alias("entries_inline"),
        F.size(F.coalesce("entries", none)).alias("entries_after_dedup"),
        F.coalesce("fallback", no).alias("glossary_used_legacy_fallback"),
        F.coalesce("section_structure", F.lit("unknown")).alias("section_structure"),
        F.when(F.col("narrowing_fired"), pages_of("parse_start", "parse_end")).alias("section_ii_pages"),
        F.coalesce("narrowing_attempted", no).alias("section_ii_narrowing_attempted"),
        F.coalesce("narrowing_fired", no).alias("section_ii_narrowing_fired"),
        F.coalesce("scan_errors", F.lit(0)).alias("section_ii_boundary_scan_errors"),
    )
    columns = [
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("filename").alias("source_pdf"),
        F.col("gcs_key").alias("source_gcs_key"),
        F.col("given_id" if "given_id" in docs.columns else "doc_id").alias("source_doc_id"),
        publication.alias("source_pub_number"),
        T.document_type(publication).alias("source_doc_type"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
        F.lit(profile.name).alias("profile"),
        F.col("text_sha256"),
        F.coalesce("entries", none).alias("entries"),
        metadata.alias("metadata"),
    ]
    if not deterministic:
        columns.append(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extraction_timestamp"))
    return out.select(*columns)


def violations(payload: DataFrame) -> DataFrame:
    """payload with `violations`: the rules of the output schema that a row breaks, in order; empty if it is valid."""
    any_entry = lambda test: F.exists("entries", test)
    length = lambda c, most: (F.coalesce(F.length(c), F.lit(0)) < 1) | (F.length(c) > most)
    rules = {
        "schema_version": F.col("schema_version") != SCHEMA_VERSION,
        "source_pdf": F.col("source_pdf").isNull(),
        "extractor_version": ~F.col("extractor_version").rlike(r"^\d+\.\d+\.\d+"),
        "text_sha256": ~F.col("text_sha256").rlike("^([0-9a-f]{64})?$"),
        "term": any_entry(lambda e: length(e["term"], 500)),
        "term_normalized": any_entry(lambda e: length(e["term_normalized"], 500)),
        "definition": any_entry(lambda e: length(e["definition"], 10000)),
        "source_type": any_entry(lambda e: ~e["source_type"].isin("glossary", "inline")),
        "pdf_page_index": any_entry(lambda e: e["pdf_page_index"] < 1),
        "confidence": any_entry(lambda e: ~e["confidence"].between(0, 1)),
        "section_structure": ~F.col("metadata.section_structure").isin("none", "section_i_only", "section_ii_only", "both", "unknown"),
        "glossary_pages": F.exists("metadata.glossary_pages", lambda p: p < 1),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items())))
    return payload.withColumn("violations", broken)


def statuses(payload: DataFrame) -> DataFrame:
    """(source_pdf, status, message): ok, no-defs, or fail with the rules that a document breaks; none fails the job."""
    checked = violations(payload)
    status = F.when(F.size("violations") > 0, "fail").when(F.size("entries") == 0, "no-defs").otherwise("ok")
    message = F.when(F.size("violations") > 0, F.concat(F.lit("schema: "), F.array_join("violations", ", ")))
    return checked.select("source_pdf", status.alias("status"), message.alias("message"))
