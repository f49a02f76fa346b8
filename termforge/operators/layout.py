"""From layout dumps to spans and physical lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SPAN = "struct<text:string,bbox:array<double>,font:string,flags:int>"
DUMP_SCHEMA = f"doc_id string, filename string, pages array<struct<text:string,height:double,label:string,read_error:boolean,blocks:array<struct<lines:array<struct<spans:array<{SPAN}>>>>>>>"


def pages_of(dumps: DataFrame) -> DataFrame:
    """pages(doc_id, page_idx, text, height, label, read_error) of nested dumps."""
    one = dumps.select("doc_id", F.posexplode("pages").alias("page_idx", "p"))
    error = F.coalesce("p.read_error", F.lit(False))
    return one.select("doc_id", "page_idx", F.col("p.text").alias("text"), F.col("p.height").alias("height"), T.page_label(F.col("p.label")).alias("label"), error.alias("read_error"))


def spans_of(dumps: DataFrame) -> DataFrame:
    """spans(doc_id, page_idx, block, line, span, text, x0, y0, font, flags): all that are not blank, of readable pages."""
    page = dumps.select("doc_id", F.posexplode("pages").alias("page_idx", "p")).where(~F.coalesce("p.read_error", F.lit(False)))
    block = page.select("doc_id", "page_idx", F.posexplode("p.blocks").alias("block", "b"))
    line = block.select("doc_id", "page_idx", "block", F.posexplode("b.lines").alias("line", "l"))
    span = line.select("doc_id", "page_idx", "block", "line", F.posexplode("l.spans").alias("span", "s"))
    flat = span.select("doc_id", "page_idx", "block", "line", "span", T.strip(F.col("s.text")).alias("text"), F.col("s.bbox")[0].alias("x0"), F.col("s.bbox")[1].alias("y0"), F.col("s.font").alias("font"), F.col("s.flags").alias("flags"))
    return flat.where("text <> ''")


def clip_above(spans: DataFrame, header: str, first_pages: DataFrame) -> DataFrame:
    """On each document's given page (doc_id, first_page), spans above the first span that meets the header go.

    Without such a span the page stays as it is.
    """
    seq = F.struct("block", "line", "span")
    hits = spans.join(first_pages, (spans.doc_id == first_pages.doc_id) & (spans.page_idx == first_pages.first_page), "left_semi").where(F.col("text").rlike(header))
    edge = hits.groupBy(F.col("doc_id").alias("d"), F.col("page_idx").alias("p")).agg(F.min_by("y0", seq).alias("edge"))
    joined = spans.join(edge, (spans.doc_id == F.col("d")) & (spans.page_idx == F.col("p")), "left")
    return joined.where("edge IS NULL OR y0 >= edge").drop("d", "p", "edge")


def lines_of(spans: DataFrame) -> DataFrame:
    """lines(doc_id, page_idx, y, spans): spans of one rounded height, left to right; rounding is half to even."""
    bold = T.is_bold(F.col("flags"), F.col("font"))
    item = F.struct("x0", "block", "line", "span", "y0", "text", bold.alias("bold"))
    return spans.groupBy("doc_id", "page_idx", F.bround("y0", 0).alias("y")).agg(F.array_sort(F.collect_list(item)).alias("spans"))


def bold_rate(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, bold_rate): how many raw lines of the documents' ranges (doc_id, start, end) begin with a bold span."""
    bold = T.is_bold(F.col("flags"), F.col("font"))
    inside = spans.join(ranges.select(F.col("doc_id").alias("d"), "start", "end"), (F.col("doc_id") == F.col("d")) & F.col("page_idx").between(F.col("start"), F.col("end")))
    first = inside.groupBy("doc_id", "page_idx", "block", "line").agg(F.min_by(bold.cast("int"), "span").alias("bold"))
    return first.groupBy("doc_id").agg(F.avg("bold").alias("bold_rate"))


def top_zone_lines(spans: DataFrame, word: str = "glossary", zone: float = 150.0) -> DataFrame:
    """(doc_id, page_idx, y_pos, line_text) of raw lines in the head of a page that hold a word: candidates for running headers."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), " ")
    raw = spans.groupBy("doc_id", "page_idx", "block", "line").agg(text.alias("full"), F.min_by("y0", "span").alias("y0"))
    return raw.where((F.col("y0") < zone) & F.lower("full").contains(word)).select("doc_id", "page_idx", F.round("y0", 1).alias("y_pos"), F.substring("full", 1, 120).alias("line_text"))
