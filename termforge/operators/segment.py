"""Lines to glossary entries: page-zone filters, new-term gates, segmentation, merging of continuations.

All windows partition by document and page, so an input that is already partitioned by doc_id is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import INLINE_SPLIT, Profile, java

HEADER_ZONE, FOOTER_ZONE = 150.0, 0.88
TERM_COLUMN, ACRONYM_COLUMN = 30.0, 80.0
MAX_FOOTERS = 5
CONFIDENCE = 0.95


def _texts(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: s["text"]), " ")


def zoned(lines: DataFrame, profile: Profile) -> DataFrame:
    """lines with full (the joined text), y0, x0, and the reason for which a line is dropped (null if it stays)."""
    first = F.element_at("spans", 1)
    out = lines.withColumn("full", _texts(F.col("spans"))).withColumn("x0", first["x0"]).withColumn("y0", first["y0"])
    header = T.is_document_header(F.col("full"), profile)
    footer = F.col("full").rlike(java(profile.footer_match(), "i")) | header
    reason = (
        F.when((F.col("y0") < HEADER_ZONE) & header, "header")
        .when((F.col("y0") > F.col("height") * FOOTER_ZONE) & footer, "footer")
        .when(F.col("full").rlike(java(profile.invalid_match(), "i")), "invalid")
    )
    return out.withColumn("dropped", reason)


def footer_warnings(lines: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, page_idx, n_footers) of pages on which suspiciously many lines went as footers."""
    n = zoned(lines, profile).where("dropped = 'footer'").groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_footers"))
    return n.where(F.col("n_footers") > MAX_FOOTERS)


def gated(lines: DataFrame, profile: Profile, legacy: bool = False) -> DataFrame:
    """Valid lines with every decision of the new-term gate as a column, and what the line adds to a definition.

    starts: the line opens an entry with `term` and `changed`; its own part of the definition is `pieces`.
    """
    valid = zoned(lines, profile).where("dropped IS NULL").drop("dropped")
    if profile.gate == INLINE_SPLIT:
        line = T.strip(F.col("full"))
        split = valid.withColumn("split", T.split_term(line, profile.split))
        marked = split.withColumn("mark", T.strip_asterisks(T.clean_term(F.col("split.term"))))
        term = F.col("mark.term")
        starts = F.col("split").isNotNull() & T.is_valid_term(term, F.length("split.definition") > 0, profile) & ~T.starts_with_stop_word(term)
        body = F.col("y0").between(HEADER_ZONE, F.col("height") * FOOTER_ZONE)
        out = marked.withColumn("starts", F.coalesce(starts, F.lit(False)))
        pieces = F.when(F.col("starts"), F.filter(F.array(F.col("split.definition")), lambda p: p != "")).when(body, F.array(line)).otherwise(F.array().cast("array<string>"))
        return out.select("doc_id", "page_idx", "y", "full", "label", "starts", term.alias("term"), F.coalesce("mark.changed", F.lit(False)).alias("changed"), pieces.alias("pieces"))
    margin = F.min("x0").over(Window.partitionBy("doc_id", "page_idx"))
    placed = valid.withColumn("margin", margin)
    column, band = F.col("x0") < F.col("margin") + TERM_COLUMN, F.col("x0") < F.col("margin") + ACRONYM_COLUMN
    bold, acronym = F.element_at("spans", 1)["bold"], T.is_acronym_line(T.strip(F.col("full")))
    gate = column if legacy or not profile.bold_gate else (column & (bold | acronym)) | (band & acronym)
    # Spans of a term's style go on with the term, up to the first that is not, that holds a sentence's end, or opens a parenthesis.
    rest = F.slice("spans", F.lit(2), F.greatest(F.size("spans"), F.lit(1)))
    stops = F.transform(rest, lambda s: ~T.is_term_span(s["text"], s["bold"]) | s["text"].rlike(java(r"[!.?]\s+[a-z]")) | s["text"].startswith("("))
    stop = F.array_position(stops, F.lit(True)).cast("int")
    n_term = F.when(stop > 0, stop).otherwise(F.size("spans"))
    walked = placed.withColumn("gate", gate).withColumn("n_term", n_term)
    head = T.strip(_texts(F.slice("spans", F.lit(1), F.col("n_term"))))
    tail = _texts(F.slice("spans", F.col("n_term") + 1, F.size("spans")))
    walked = walked.withColumn("head", head).withColumn("tail", tail).withColumn("split", T.split_term(F.col("head")))
    inner = F.when(F.length("split.term") < T.MAX_SPLIT_TERM, F.col("split.definition"))
    raw = F.when(F.length("split.term") < T.MAX_SPLIT_TERM, F.col("split.term")).otherwise(F.col("head"))
    marked = walked.withColumn("inner", F.coalesce(inner, F.lit(""))).withColumn("mark", T.strip_asterisks(T.clean_term(raw)))
    term = F.col("mark.term")
    out = marked.withColumn("starts", F.col("gate") & T.is_valid_term(term, F.col("inner") != "", profile))
    pieces = F.when(F.col("starts"), F.filter(F.array("inner", "tail"), lambda p: p != "")).otherwise(F.array("full"))
    return out.select("doc_id", "page_idx", "y", "full", "label", "starts", term.alias("term"), F.col("mark.changed").alias("changed"), pieces.alias("pieces"))


def segmented(gates: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, page_idx, entry_no, label, term, changed, definition): an entry from each start to the next, within its page.

    Lines before the first start are dropped; entries without a usable definition are not emitted.
    """
    order = Window.partitionBy("doc_id", "page_idx").orderBy("y")
    numbered = gates.withColumn("entry_no", F.sum(F.col("starts").cast("int")).over(order)).where("entry_no > 0")
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "pieces"))), lambda s: s["pieces"]))
    entry = numbered.groupBy("doc_id", "page_idx", "entry_no").agg(
        F.first("label").alias("label"),
        F.max(F.when(F.col("starts"), F.col("term"))).alias("term"),
        F.max(F.when(F.col("starts"), F.col("changed"))).alias("changed"),
        F.array_join(parts, " ").alias("raw"),
    )
    clean = entry.withColumn("definition", T.clean_definition(F.col("raw"), profile)).drop("raw")
    return clean.where(T.is_kept_definition(F.col("definition")))


def merged(entries: DataFrame) -> DataFrame:
    """Entries whose 'term' is the rest of the sentence before are folded into the entry before.

    A merged definition ends as its last part does, so whether an entry is folded depends on its direct neighbour only.
    """
    order = Window.partitionBy("doc_id", "page_idx").orderBy("entry_no")
    before = F.lag("definition").over(order)
    folded = before.isNotNull() & ~T.ends_sentence(before) & T.is_fragment(F.col("term"))
    numbered = entries.withColumn("folded", F.coalesce(folded, F.lit(False))).withColumn("group", F.sum((~F.col("folded")).cast("int")).over(order))
    part = F.struct("entry_no", F.when(F.col("folded"), F.concat_ws(" ", "term", "definition")).otherwise(F.col("definition")).alias("text"))
    first = lambda c: F.min_by(c, "entry_no").alias(c)
    return numbered.groupBy("doc_id", "page_idx", "group").agg(
        F.min("entry_no").alias("entry_no"), first("label"), first("term"), first("changed"),
        T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), " ")).alias("definition"),
    ).drop("group")


def glossary_entries(lines: DataFrame, profile: Profile, legacy: bool = False, unicode_form: bool = True) -> DataFrame:
    """Entries of the glossary lines (doc_id, page_idx, y, spans, height, label), in the shape of the output schema.

    seq numbers a document's entries in the order in which a reader meets them.
    """
    found = merged(segmented(gated(lines, profile, legacy), profile))
    return found.select(
        "doc_id",
        F.struct(F.lit(0).alias("source"), F.col("page_idx").cast("int").alias("page"), F.lit(0).alias("pattern"), F.col("entry_no").cast("int").alias("no")).alias("seq"),
        "term",
        T.normalize_term(F.col("term"), unicode_form).alias("term_normalized"),
        "definition",
        F.lit("glossary").alias("source_type"),
        F.lit("Glossary").alias("section"),
        (F.col("page_idx") + 1).cast("int").alias("pdf_page_index"),
        F.col("label").alias("printed_page_label"),
        F.lit(CONFIDENCE).alias("confidence"),
        F.when(F.col("changed"), F.array(F.lit(T.CHANGED_FLAG))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )
