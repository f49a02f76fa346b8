"""Where a document's glossary is: text layer, page range, section structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import diagnose as D
from ..functions import patterns as P
from ..functions import text as T
from ..functions.patterns import Profile, java


def is_sampled(page: Column, total: Column) -> Column:
    """The first five pages, the last five, and evenly spaced ones between in documents of more than ten."""
    step = F.greatest(F.lit(1), F.floor(total / 6))
    middle = (total > 10) & (page % step == 0) & (page >= step) & (page < total - step)
    return (page < 5) | (page >= total - 5) | middle


def text_layers(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages, text_layer_present, text_sha256); the hash is null without a text layer."""
    text = F.coalesce("text", F.lit(""))
    # One aggregation: the page count is not known before it, so pages of enough text are collected by number.
    long = F.when(F.length(T.strip(text)) > T.TEXT_LAYER, F.col("page_idx"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", text.alias("text")))), lambda p: p["text"]), "")
    found = pages.groupBy("doc_id").agg((F.max("page_idx") + 1).alias("total_pages"), F.collect_set(long).alias("long"), whole.alias("whole"))
    present = F.exists("long", lambda p: is_sampled(p, F.col("total_pages")))
    return found.select("doc_id", "total_pages", present.alias("text_layer_present"), F.when(present, T.sha256(F.col("whole"))).alias("text_sha256"))


def header_blocks(pages: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, start, last, pages): runs of consecutive pages that meet a glossary header."""
    hit = F.col("text").rlike(java(P.any_of(profile.headers), "im")) & ~F.col("read_error")
    numbered = pages.where(hit).select("doc_id", "page_idx").withColumn("run", F.col("page_idx") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx")))
    return numbered.groupBy("doc_id", "run").agg(F.min("page_idx").alias("start"), F.max("page_idx").alias("last"), F.count("*").alias("pages")).drop("run")


def confirmed(blocks: DataFrame, pages: DataFrame, profile: Profile) -> DataFrame:
    """Blocks that read like a glossary rather than a table of contents, with two pages after them as context."""
    if profile.confirm is None:
        return blocks
    least, most = profile.confirm
    text = F.when(F.col("read_error"), "").otherwise(F.coalesce("text", F.lit("")))
    near = blocks.join(pages.select(F.col("doc_id").alias("d"), "page_idx", text.alias("text")), (F.col("doc_id") == F.col("d")) & F.col("page_idx").between(F.col("start"), F.col("last") + 2))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "text"))), lambda p: p["text"]), "\n")
    joined = near.groupBy("doc_id", "start", "last", "pages").agg(whole.alias("whole"))
    good = (F.regexp_count("whole", F.lit(java(P.TERM_LINE, "m"))) >= least) & (F.regexp_count("whole", F.lit(java(P.DOT_LEADER))) <= most)
    return joined.where(good).drop("whole")


def glossary_ranges(pages: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, start, end) of the largest, then latest, confirmed block, up to the page before the next end mark."""
    blocks = confirmed(header_blocks(pages, profile), pages, profile)
    best = blocks.groupBy("doc_id").agg(F.max(F.struct("pages", "start")).alias("best")).select("doc_id", F.col("best.start").alias("start"))
    ends = F.col("text").rlike(java(P.RANGE_END, "im"))
    cover = F.col("text").rlike(java(P.BACK_COVER, "i"))
    # Flags are taken before the shuffle, so no page text is moved.
    flags = pages.select(F.col("doc_id").alias("d"), "page_idx", F.coalesce(ends & ~F.col("read_error"), F.lit(False)).alias("ends"), F.coalesce(cover & ~F.col("read_error"), F.lit(False)).alias("cover"))
    light = flags.withColumn("total", F.max("page_idx").over(Window.partitionBy("d")) + 1)
    stop = (F.col("page_idx") > F.col("start")) & (F.col("ends") | (F.col("cover") & (F.col("total") - F.col("page_idx") <= 3)))
    return best.join(light, F.col("doc_id") == F.col("d")).groupBy("doc_id", "start").agg(F.coalesce(F.min(F.when(stop, F.col("page_idx") - 1)), F.max("total") - 1).alias("end"))


def sections(pages: DataFrame, ranges: DataFrame, profile: Profile) -> DataFrame:
    """Section structure of the ranges, and the range narrowed to Section II where it has one.

    (doc_id, start, end, section_structure, parse_start, parse_end, narrowing_attempted, narrowing_fired, scan_errors).
    A page that can't be read before both headers are found makes the structure unknown.
    """
    if profile.section_two is None:
        same = [F.lit("unknown").alias("section_structure"), F.col("start").alias("parse_start"), F.col("end").alias("parse_end"), F.lit(False).alias("narrowing_attempted"), F.lit(False).alias("narrowing_fired"), F.lit(0).alias("scan_errors")]
        return ranges.select("doc_id", "start", "end", *same)
    bad = F.col("read_error")
    meets = [F.coalesce(F.col("text").rlike(java(p, "im")) & ~bad, F.lit(False)).alias(n) for p, n in ((profile.section_one, "one"), (profile.section_two, "two"), (profile.section_after, "after"))]
    flags = pages.select(F.col("doc_id").alias("d"), "page_idx", bad.alias("bad"), *meets)
    inside = ranges.join(flags, (F.col("doc_id") == F.col("d")) & F.col("page_idx").between(F.col("start"), F.col("end")))
    first = inside.withColumn("two_at", F.min(F.when(F.col("two"), F.col("page_idx"))).over(Window.partitionBy("doc_id")))
    page = F.col("page_idx")
    cut = F.min(F.when(F.col("after") & (page > F.col("two_at")), page))
    g = first.groupBy("doc_id", "start", "end").agg(
        F.min(F.when(F.col("one"), page)).alias("one_at"),
        F.min("two_at").alias("two_at"),
        F.min(F.when(F.col("bad"), page)).alias("bad_at"),
        cut.alias("cut"),
        F.collect_list(F.when(F.col("bad"), page)).alias("bad_pages"),
    )
    far = F.lit(2**31 - 1)
    unknown = F.col("bad_at") < F.greatest(F.coalesce("one_at", far), F.coalesce("two_at", far))
    label = (
        F.when(unknown, "unknown")
        .when(F.col("one_at").isNotNull() & F.col("two_at").isNotNull(), "both")
        .when(F.col("two_at").isNotNull(), "section_ii_only")
        .when(F.col("one_at").isNotNull(), "section_i_only")
        .otherwise("none")
    )
    fired = F.col("section_structure").isin("both", "section_ii_only")
    last = F.coalesce("cut", F.col("end") + 1)
    scanned = F.size(F.filter("bad_pages", lambda p: (p > F.col("two_at")) & (p < last)))
    return g.withColumn("section_structure", label).select(
        "doc_id", "start", "end", "section_structure",
        F.when(fired, F.col("two_at")).otherwise(F.col("start")).alias("parse_start"),
        F.when(fired, last - 1).otherwise(F.col("end")).alias("parse_end"),
        fired.alias("narrowing_attempted"), fired.alias("narrowing_fired"),
        F.when(fired, scanned).otherwise(F.lit(0)).alias("scan_errors"),
    )


def gap_findings(pages: DataFrame, profile: Profile) -> DataFrame:
    """(doc_id, first_pages, second_pages, combined): neighbouring blocks that a tolerance of one page would make the largest."""
    by_doc = Window.partitionBy("doc_id")
    order = by_doc.orderBy("start")
    b = header_blocks(pages, profile).withColumn("next", F.lead("start").over(order)).withColumn("next_pages", F.lead("pages").over(order)).withColumn("largest", F.max("pages").over(by_doc))
    combined = F.col("pages") + F.col("next_pages") + 1
    pairs = b.where((F.col("next") == F.col("last") + 2) & (combined > F.col("largest")) & (combined >= 5)).withColumn("gap", F.col("last") + 1)
    full = pages.where(F.length("text") >= 200).select(F.col("doc_id").alias("d"), "page_idx")
    return pairs.join(full, (F.col("doc_id") == F.col("d")) & (F.col("gap") == F.col("page_idx"))).select("doc_id", F.col("pages").alias("first_pages"), F.col("next_pages").alias("second_pages"), combined.alias("combined"))


def loose_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, start, end) from the first page with a loosely written header that is not in a table of contents."""
    header = java(D.LOOSE_HEADER, "i")
    # What follows the first match: all but the first piece, the text being cut at most once.
    after = F.substring(F.coalesce(F.try_element_at(F.split("text", header, 2), F.lit(2)), F.lit("")), 1, 80)
    lead = after.contains("…") | after.contains("....") | F.regexp_extract(after, r"^[^\n]*", 0).rlike(java(r"^\s*\d+\s*$"))
    contents = lead & (F.regexp_count("text", F.lit(r"\.{4,}")) >= 5)
    fine = ~F.col("read_error")
    flags = pages.select("doc_id", "page_idx", (fine & F.col("text").rlike(header) & ~contents).alias("starts"), (fine & F.col("text").rlike(java(D.LOOSE_END, "i"))).alias("ends"))
    w = Window.partitionBy("doc_id")
    at = flags.withColumn("start", F.min(F.when(F.col("starts"), F.col("page_idx"))).over(w)).where("start IS NOT NULL")
    stop = F.min(F.when(F.col("ends") & (F.col("page_idx") > F.col("start")), F.col("page_idx") - 1))
    return at.groupBy("doc_id", "start").agg(F.greatest(F.coalesce(stop, F.max("page_idx")), F.first("start")).alias("end"))
