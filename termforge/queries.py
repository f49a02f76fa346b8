"""Queries for the operators, over the test tables: each over its whole table, with SQL where SQL can express it.

The tables hold no glossaries, so most queries use the `synthetic` profile, whose patterns this prose meets; cases of
the other profiles come as literal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import duck
from .functions import classify as C
from .functions import diagnose as D
from .functions import patterns as P
from .functions import text as T
from .functions.patterns import ARMY, DOD, SYNTHETIC, java
from .operators import evaluate, layout, ranges, segment
from .operators.dedup import dedupe
from .operators.inline import inline_entries
from .plans import pipeline
from .sources import readers
from .sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else " || chr(10) || ".join(duck.q(p) for p in v.split("\n"))
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


def glossary_of(spark: SparkSession, sf_dir: str, unicode_form: bool = True) -> DataFrame:
    lines = readers.text_lines(table(spark, sf_dir, "documents")).repartition("doc_id")
    return segment.glossary_entries(lines, DOD, unicode_form=unicode_form)


# Entries


@query("WITH " + duck.entries(DOD) + " SELECT doc_id, CAST(ord AS INTEGER) AS ord, term, term_normalized, definition, CAST(page_idx + 1 AS INTEGER) AS pdf_page_index, 0.95::DOUBLE AS confidence, '' AS flags FROM best")
def extract_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lines, term gate, segmentation, cleaning, merging, keys, deduplication."""
    best = dedupe(glossary_of(spark, sf_dir))
    return best.select("doc_id", "ord", "term", "term_normalized", "definition", "pdf_page_index", "confidence", F.array_join("flags", ",").alias("flags"))


@query("WITH " + duck.entries(DOD) + " SELECT doc_id, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (WHERE r = 1) AS BIGINT) AS after_dedup, CAST(count(DISTINCT page_idx) AS BIGINT) AS pages_with_entries FROM ranked GROUP BY doc_id")
def entry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document-level counts before and after deduplication."""
    every = glossary_of(spark, sf_dir).where("term_normalized <> ''")
    return every.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_distinct("term_normalized").alias("after_dedup"), F.count_distinct("pdf_page_index").alias("pages_with_entries"))


@query("WITH " + duck.entries(DOD) + ", t AS (SELECT doc_id, list_sort(list(DISTINCT term_normalized)) AS s FROM best GROUP BY doc_id) SELECT doc_id, array_to_string(s, '|') AS term_set FROM t")
def document_term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.term_sets(glossary_of(spark, sf_dir), "doc_id").select("doc_id", F.array_join("term_set", "|").alias("term_set"))


@query("WITH " + duck.entries(DOD) + " SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS starts, CAST(sum(CASE WHEN starts THEN length(cand) ELSE 0 END) AS BIGINT) AS term_chars, CAST(sum(length(CASE WHEN starts THEN def ELSE line END)) AS BIGINT) AS piece_chars FROM gate GROUP BY doc_id")
def gate_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the term gate of text decides, line by line, counted."""
    lines = segment.gated(readers.text_lines(table(spark, sf_dir, "documents")), DOD)
    return gate_counts(lines)


def gate_counts(lines: DataFrame) -> DataFrame:
    starts = F.col("starts")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(starts).alias("starts"), F.sum(F.when(starts, F.length("term")).otherwise(0)).alias("term_chars"), F.sum(F.length(F.array_join("pieces", " "))).alias("piece_chars"))


@query("WITH " + duck.pages("(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)") + ", " + duck.entries(DOD, "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)").lstrip() + " SELECT doc_id, term, definition FROM best")
def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan over another table's texts."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return dedupe(segment.glossary_entries(readers.text_lines(turns).repartition("doc_id"), DOD)).select("doc_id", "term", "definition")


def _inline_sql(source: str, key: str) -> str:
    parts = []
    for k, p in enumerate(SYNTHETIC.inline):
        groups = [f"regexp_extract_all(f, {duck.rx(p, 'm')}, {g})" for g in (1, 2)]
        parts.append(f"SELECT doc_id, page_idx, {k} AS pattern, f, unnest({groups[0]}) AS t, unnest({groups[1]}) AS d, unnest(range(len({groups[0]}))) AS no FROM fixed")
    term = duck.strip("t")
    term = duck.sub(duck.sub(term, r"^the\s+(?:term|word|phrase|expression)\s+", "", "i"), r"^(?:the|an|a)\s+", "", "i")
    section = f"CASE WHEN {duck.meets('f', P.CHAPTER, 'i')} THEN 'Chapter ' || regexp_extract(f, {duck.rx(P.CHAPTER, 'i')}, 1) WHEN {duck.meets('f', P.SECTION)} THEN 'Section ' || regexp_extract(f, {duck.rx(P.SECTION)}, 1) END"
    return "WITH " + duck.pages(source, key) + f""",
fixed AS (SELECT doc_id, page_idx, {duck.spacing('text')} AS f FROM page WHERE length({duck.spacing('text')}) >= 50),
m AS ({' UNION ALL '.join(parts)}),
c AS (SELECT doc_id, page_idx, pattern, no, f, trim({term}, ' ''"') AS term, {duck.strip('d')} AS d FROM m)
SELECT doc_id, CAST(page_idx + 1 AS INTEGER) AS pdf_page_index, term, {duck.normalize('term')} AS term_normalized, {duck.citations('d', SYNTHETIC.citation)} AS definition, {section} AS section, 0.65::DOUBLE AS confidence
FROM c WHERE term <> '' AND length(d) BETWEEN 10 AND 1500 AND NOT {duck.gibberish('d')}"""


@query(_inline_sql("documents", "doc_id"))
def inline_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions in running text."""
    pages = readers.text_pages(table(spark, sf_dir, "documents"))
    return inline_entries(pages, SYNTHETIC).select("doc_id", "pdf_page_index", "term", "term_normalized", "definition", "section", "confidence")


@query(_inline_sql("(SELECT item_id AS doc_id, text FROM benchmark)", "doc_id"))
def inline_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = readers.text_pages(table(spark, sf_dir, "benchmark"), "item_id")
    return inline_entries(pages, SYNTHETIC).select("doc_id", "pdf_page_index", "term", "term_normalized", "definition", "section", "confidence")


# Ranges


@query("WITH " + duck.pages() + f""",
t AS (SELECT doc_id, CAST(max(page_idx) + 1 AS INTEGER) AS n, string_agg(text, '' ORDER BY page_idx) AS whole FROM page GROUP BY doc_id),
s AS (SELECT p.doc_id FROM page p JOIN t USING (doc_id) WHERE length({duck.strip('p.text')}) > 100 AND (p.page_idx < 5 OR p.page_idx >= t.n - 5 OR (t.n > 10 AND p.page_idx % greatest(1, t.n // 6) = 0 AND p.page_idx >= greatest(1, t.n // 6) AND p.page_idx < t.n - greatest(1, t.n // 6))))
SELECT doc_id, n AS total_pages, doc_id IN (SELECT doc_id FROM s) AS text_layer_present, CASE WHEN doc_id IN (SELECT doc_id FROM s) THEN sha256(whole) END AS text_sha256 FROM t""")
def text_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether there is text enough on sampled pages, and the hash of all text."""
    return ranges.text_layers(readers.text_pages(table(spark, sf_dir, "documents")))


@query("WITH " + duck.pages() + ", " + duck.ranges(SYNTHETIC).lstrip() + " SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS end FROM span")
def glossary_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest block of pages with a header, up to the next end mark."""
    found = ranges.glossary_ranges(readers.text_pages(table(spark, sf_dir, "documents")), SYNTHETIC)
    return found.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("WITH " + duck.pages() + ", " + duck.ranges(SYNTHETIC).lstrip() + f""",
f AS (SELECT x.doc_id, x.s, x.e, p.page_idx, {duck.meets('p.text', SYNTHETIC.section_one, 'im')} AS one, {duck.meets('p.text', SYNTHETIC.section_two, 'im')} AS two, {duck.meets('p.text', SYNTHETIC.section_after, 'im')} AS aft FROM span x JOIN page p ON p.doc_id = x.doc_id AND p.page_idx BETWEEN x.s AND x.e),
a AS (SELECT doc_id, s, e, min(page_idx) FILTER (WHERE one) AS i1, min(page_idx) FILTER (WHERE two) AS i2 FROM f GROUP BY doc_id, s, e),
b AS (SELECT a.*, (SELECT min(f.page_idx) FROM f WHERE f.doc_id = a.doc_id AND f.aft AND f.page_idx > a.i2) AS cut FROM a)
SELECT doc_id, CASE WHEN i1 IS NOT NULL AND i2 IS NOT NULL THEN 'both' WHEN i2 IS NOT NULL THEN 'section_ii_only' WHEN i1 IS NOT NULL THEN 'section_i_only' ELSE 'none' END AS section_structure,
CAST(CASE WHEN i2 IS NOT NULL THEN i2 ELSE s END AS INTEGER) AS parse_start, CAST(CASE WHEN i2 IS NOT NULL THEN coalesce(cut - 1, e) ELSE e END AS INTEGER) AS parse_end, i2 IS NOT NULL AS narrowing_fired FROM b""")
def section_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section label of each range, and the range narrowed to its second section."""
    pages = readers.text_pages(table(spark, sf_dir, "documents"))
    found = ranges.sections(pages, ranges.glossary_ranges(pages, SYNTHETIC), SYNTHETIC)
    return found.select("doc_id", "section_structure", F.col("parse_start").cast("int").alias("parse_start"), F.col("parse_end").cast("int").alias("parse_end"), "narrowing_fired")


@query("WITH " + duck.pages() + ", " + duck.ranges(SYNTHETIC).lstrip() + """,
nb AS (SELECT *, lead(s) OVER w AS ns, lead(pages) OVER w AS np, max(pages) OVER (PARTITION BY doc_id) AS big FROM block WINDOW w AS (PARTITION BY doc_id ORDER BY s))
SELECT nb.doc_id, nb.pages AS first_pages, nb.np AS second_pages, nb.pages + nb.np + 1 AS combined FROM nb JOIN page p ON p.doc_id = nb.doc_id AND p.page_idx = nb.l + 1 WHERE nb.ns = nb.l + 2 AND nb.pages + nb.np + 1 > nb.big AND nb.pages + nb.np + 1 >= 5 AND length(p.text) >= 200""")
def gap_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.gap_findings(readers.text_pages(table(spark, sf_dir, "documents")), SYNTHETIC)


@query("WITH " + duck.pages() + ", " + duck.ranges(SYNTHETIC).lstrip() + " SELECT span.doc_id, CAST(count(*) AS BIGINT) AS range_pages, CAST(sum(length(page.text)) AS BIGINT) AS chars FROM span JOIN page ON page.doc_id = span.doc_id AND page.page_idx BETWEEN s AND e GROUP BY span.doc_id")
def pages_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of pages with the ranges that they lie in."""
    pages = readers.text_pages(table(spark, sf_dir, "documents"))
    own = ranges.glossary_ranges(pages, SYNTHETIC).select(F.col("doc_id").alias("d"), "start", "end")
    return pages.join(own, (F.col("doc_id") == F.col("d")) & F.col("page_idx").between(F.col("start"), F.col("end"))).groupBy("doc_id").agg(F.count("*").alias("range_pages"), F.sum(F.length("text")).alias("chars"))


# Layout


_SPANS_SQL = rf"""
el AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, regexp_extract_all(html, {duck.rx(readers._ELEMENT, 'i')}, 1) AS k, regexp_extract_all(html, {duck.rx(readers._ELEMENT, 'i')}, 2) AS t FROM pages),
sp AS (SELECT doc_id, unnest(range(len(k))) AS n, unnest(k) AS k, unnest(t) AS t FROM el),
sq AS (SELECT doc_id, n, n // 30 AS page_idx, lower(k) AS k, {duck.strip(duck.squeeze('t'))} AS text FROM sp),
spans AS (SELECT *, CASE k WHEN 'nav' THEN 100.0 WHEN 'footer' THEN 720.0 ELSE 200.0 + 14 * (n % 30) END AS y, CASE k WHEN 'li' THEN 112.0 WHEN 'b' THEN 82.0 ELSE 72.0 END AS x, k IN ('h1', 'title', 'b') AS bold FROM sq WHERE text <> ''),
ln AS (SELECT doc_id, page_idx, y, string_agg(text, ' ' ORDER BY x, n) AS line_text, arg_min(x, x * 1e6 + n) AS x, arg_min(bold, x * 1e6 + n) AS bold, arg_min(text, x * 1e6 + n) AS head, count(*) AS spans FROM spans GROUP BY doc_id, page_idx, y)"""


@query("WITH " + _SPANS_SQL.lstrip() + " SELECT doc_id, CAST(page_idx AS INTEGER) AS page_idx, CAST(y AS DOUBLE) AS y, line_text, CAST(x AS DOUBLE) AS x0, bold, CAST(spans AS INTEGER) AS n_spans FROM ln")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of web pages as physical lines."""
    lines = layout.lines_of(readers.html_spans(table(spark, sf_dir, "pages")))
    first = F.element_at("spans", 1)
    return lines.select("doc_id", "page_idx", "y", F.array_join(F.transform("spans", lambda s: s["text"]), " ").alias("line_text"), first["x0"].alias("x0"), first["bold"].alias("bold"), F.size("spans").alias("n_spans"))


def _page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.lines_of(readers.html_spans(table(spark, sf_dir, "pages")))
    return lines.withColumn("height", F.lit(readers.HEIGHT)).withColumn("label", F.lit(None).cast("string"))


@query("WITH " + _SPANS_SQL.lstrip() + f""",
z AS (SELECT *, {duck.meets('line_text', P.any_of(SYNTHETIC.document_headers), 'i')} AS hd, {duck.meets('line_text', SYNTHETIC.footer_match(), 'i')} AS ft, {duck.meets('line_text', SYNTHETIC.invalid_match(), 'i')} AS bad FROM ln)
SELECT coalesce(CASE WHEN y < 150 AND hd THEN 'header' WHEN y > 792 * 0.88 AND (ft OR hd) THEN 'footer' WHEN bad THEN 'invalid' END, 'kept') AS fate, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY 1""")
def zone_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go for their place on the page or their shape."""
    return segment.zoned(_page_lines(spark, sf_dir), SYNTHETIC).groupBy(F.coalesce("dropped", F.lit("kept")).alias("fate")).agg(F.count("*").alias("n"))


_GATE_COUNTS = " SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE starts) AS BIGINT) AS starts, CAST(sum(CASE WHEN starts THEN length(cand) ELSE 0 END) AS BIGINT) AS term_chars, CAST(sum(length(CASE WHEN starts THEN def ELSE line END)) AS BIGINT) AS piece_chars FROM gate GROUP BY doc_id"


@query("WITH " + _SPANS_SQL.lstrip() + "," + duck.spatial_gate(ARMY) + _GATE_COUNTS)
def spatial_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-term lines by place and type."""
    return gate_counts(segment.gated(_page_lines(spark, sf_dir), ARMY))


@query("WITH " + _SPANS_SQL.lstrip() + "," + duck.spatial_gate(ARMY, legacy=True) + _GATE_COUNTS)
def legacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New-term lines by place alone."""
    return gate_counts(segment.gated(_page_lines(spark, sf_dir), ARMY, legacy=True))


_SPATIAL = "WITH " + _SPANS_SQL.lstrip() + "," + duck.spatial_gate(ARMY) + ",\n" + duck.entry_tail(ARMY)


@query(_SPATIAL + " SELECT doc_id, term, term_normalized, definition, CAST(page_idx + 1 AS INTEGER) AS pdf_page_index FROM named")
def spatial_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of web pages by the spatial gate."""
    return segment.glossary_entries(_page_lines(spark, sf_dir), ARMY).select("doc_id", "term", "term_normalized", "definition", "pdf_page_index")


@query("WITH " + _SPANS_SQL.lstrip() + " SELECT doc_id, round(avg(CAST(bold AS INTEGER)), 6) AS bold_rate FROM spans GROUP BY doc_id")
def bold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many raw lines begin in bold: what the choice of the gate depends on."""
    spans = readers.html_spans(table(spark, sf_dir, "pages"))
    whole = spans.groupBy("doc_id").agg(F.lit(0).alias("start"), F.max("page_idx").alias("end"))
    return layout.bold_rate(spans, whole).select("doc_id", F.round("bold_rate", 6).alias("bold_rate"))


@query("WITH " + _SPANS_SQL.lstrip() + f""",
h AS (SELECT doc_id, page_idx, arg_min(y, n) AS edge FROM spans WHERE page_idx = 0 AND {duck.meets('text', SYNTHETIC.section_two, 'im')} GROUP BY doc_id, page_idx)
SELECT spans.doc_id, CAST(count(*) AS BIGINT) AS spans_left FROM spans LEFT JOIN h USING (doc_id, page_idx) WHERE edge IS NULL OR y >= edge GROUP BY spans.doc_id""")
def clipped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans above a section's header on its first page go."""
    spans = readers.html_spans(table(spark, sf_dir, "pages"))
    firsts = spans.select("doc_id").distinct().withColumn("first_page", F.lit(0))
    return layout.clip_above(spans, java(SYNTHETIC.section_two, "im"), firsts).groupBy("doc_id").agg(F.count("*").alias("spans_left"))


@query("WITH " + _SPANS_SQL.lstrip() + " SELECT doc_id, CAST(page_idx AS INTEGER) AS page_idx, CAST(y AS DOUBLE) AS y_pos, substr(text, 1, 120) AS line_text FROM spans WHERE y < 150 AND contains(lower(text), 'home')")
def top_zone_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the head of a page that hold a word."""
    return layout.top_zone_lines(readers.html_spans(table(spark, sf_dir, "pages")), "home")


@query()
def payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: a versioned output document for each web page (its parts have queries of their own)."""
    raw = table(spark, sf_dir, "pages")
    spans = readers.html_spans(raw)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"]), "\n")
    pages = spans.groupBy("doc_id", "page_idx").agg(text.alias("text")).select("doc_id", "page_idx", "text", F.lit(readers.HEIGHT).alias("height"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("read_error"))
    docs = raw.select(F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("filename"), F.lit(None).cast("string").alias("gcs_key"))
    profile = P.Profile(**{**SYNTHETIC.__dict__, "gate": P.SPATIAL})
    out = pipeline.payloads(docs, pages, spans, profile)
    return out.select("source_doc_id", "source_pdf", "text_sha256", "metadata.*", F.size("entries").alias("n_entries"), F.to_json("entries").alias("entries_json"))


@query("WITH " + duck.entries(DOD) + ", s AS (SELECT doc_id, bool_or(length(term) > 500 OR length(term_normalized) > 500) AS long_term, bool_or(length(definition) > 10000) AS long_definition FROM best GROUP BY doc_id) SELECT 'doc' || d.doc_id AS source_pdf, CASE WHEN long_term OR long_definition THEN 'fail' WHEN s.doc_id IS NULL THEN 'no-defs' ELSE 'ok' END AS status, CASE WHEN long_term OR long_definition THEN 'schema: ' || array_to_string(list_filter([CASE WHEN long_term THEN 'term, term_normalized' END, CASE WHEN long_definition THEN 'definition' END], lambda x: x IS NOT NULL), ', ') END AS message FROM documents d LEFT JOIN s ON s.doc_id = CAST(d.doc_id AS VARCHAR)")
def payload_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each document, with the schema rules that it breaks."""
    return pipeline.statuses(payload_rows(spark, sf_dir)).withColumn("source_pdf", F.regexp_replace("source_pdf", "[.]pdf$", ""))


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output document for each text."""
    docs = table(spark, sf_dir, "documents")
    every = glossary_of(spark, sf_dir)
    entry = F.struct("ord", *pipeline.ENTRY)
    best = dedupe(every).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*(e[n].alias(n) for n in pipeline.ENTRY))).alias("entries"))
    row = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("1").alias("schema_version"), F.concat(F.lit("doc"), "doc_id", F.lit(".pdf")).alias("source_pdf"), F.lit(pipeline.EXTRACTOR_VERSION).alias("extractor_version"), T.sha256(F.col("text")).alias("text_sha256"))
    meta = F.struct(F.lit("none").alias("section_structure"), F.array().cast("array<int>").alias("glossary_pages")).alias("metadata")
    none = F.array().cast(best.schema["entries"].dataType)
    return row.join(best, "doc_id", "left").select("schema_version", "source_pdf", F.col("doc_id").alias("source_doc_id"), "extractor_version", F.lit(DOD.name).alias("profile"), "text_sha256", F.coalesce("entries", none).alias("entries"), meta)


# Scalar functions


@query(f"SELECT doc_id, {duck.normalize('text')} AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all texts. (The tables hold no character that the compatibility form changes, so the canonical form will do in SQL.)"""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_term(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, {duck.gibberish('text')} AS gibberish FROM documents")
def gibberish_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.is_gibberish(F.col("text")).alias("gibberish"))


@query(f"""WITH j AS (SELECT l.quality, {duck.gibberish('d.text')} AS g FROM documents d JOIN labels l USING (doc_id)),
a AS (SELECT count(*) FILTER (WHERE NOT g AND quality = 1) AS tp, count(*) FILTER (WHERE NOT g AND quality = 0) AS fp, count(*) FILTER (WHERE g AND quality = 1) AS fn FROM j)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 3) AS "precision", round(tp / (tp + fn), 3) AS recall FROM a""")
def gibberish_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gibberish test as a predictor of the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.is_gibberish(F.col("text")).alias("g"))
    good = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("q"))
    a = docs.join(good, "doc_id").agg(F.count_if(~F.col("g") & F.col("q")).alias("tp"), F.count_if(~F.col("g") & ~F.col("q")).alias("fp"), F.count_if(F.col("g") & F.col("q")).alias("fn"))
    return a.select("tp", "fp", "fn", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 3).alias("precision"), F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 3).alias("recall"))


@query(f"SELECT doc_id, {duck.spacing('text')} AS fixed FROM documents WHERE {duck.meets('text', P.SPACED)}")
def ocr_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(java(P.SPACED_ASCII))).select("doc_id", T.fix_ocr_spacing(F.col("text")).alias("fixed"))


_MEASURES = {
    "vowel_ratio": (D.vowel_ratio, "CASE WHEN length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 100 THEN length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) ELSE 0 END"),
    "control_rate": (D.control_rate, "len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0e-\\x1f]')) / greatest(length(text), 1)"),
    "replacement_rate": (D.replacement_rate, "(length(text) - length(replace(text, '�', ''))) / greatest(length(text), 1)"),
    "newline_rate": (D.newline_rate, "(length(text) - length(replace(text, chr(10), ''))) / greatest(length(text), 1)"),
    "longest_space_run": (D.longest_space_run, "coalesce(list_max(list_transform(regexp_extract_all(text, ' +'), lambda x: length(x))), 0)"),
    "sentences_per_thousand": (D.sentences_per_thousand, "len(regexp_extract_all(text, '[.!?]\\s')) * 1000 / greatest(length(text), 1)"),
    "page_breaks": (D.page_breaks, "greatest(len(regexp_extract_all(text, '--\\s*\\d+\\s+of\\s+\\d+\\s*--')), len(regexp_extract_all(text, '\\f')))"),
}


@query("SELECT doc_id, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 9) AS {name}" for name, (_, sql) in _MEASURES.items()) + ", regexp_matches(text, '(?i)(^|\\n)\\s*glossary(\\s+of\\s+(terms?|acronyms?|abbreviations?))?\\s*(\\n|$)') AS loose_header FROM documents")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of extracted text, in one pass."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(F.round(f(text).cast("double"), 9).alias(name) for name, (f, _) in _MEASURES.items()), D.has_loose_header(text).alias("loose_header"))


def case(name: str, doc: str, rows: list[tuple], columns: str, make: Callable[..., dict[str, Column]], sql: str | None) -> None:
    """A query over literal rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = literal(spark, rows, columns)
        names = df.columns
        return df.select(*names, *(c.alias(n) for n, c in make(*(F.col(n) for n in names)).items()))

    run.__name__, run.__doc__ = name, doc
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    query(f"SELECT {names}, {sql} FROM {values(rows, names)}" if sql else None)(run)


_TERMS = [("U.C.M.J.",), ("Joint  Force\tCommander",), ("“Curly” ‘marks’",), ("long-\nterm",), ("e.g., this",), ("Staff, U.S. Army",), ("  ",), ("AR 5, and more",), ("self- aid",)]
case("normalize_cases", "Keys of odd terms.", _TERMS, "term string", lambda t: {"key": T.normalize_term(t)}, f"{duck.normalize('term')} AS key")

_STARS = [("*Unit status",), ("** Task",), ("***",), ("plain*star",), ("",), ("* *x",)]
case("asterisk_cases", "Marks of changed entries.", _STARS, "raw string", lambda t: {"term": T.strip_asterisks(t)["term"], "changed": T.strip_asterisks(t)["changed"]}, "CASE WHEN starts_with(raw, '*') AND regexp_replace(raw, '^\\*+\\s*', '') <> '' THEN regexp_replace(raw, '^\\*+\\s*', '') ELSE raw END AS term, starts_with(raw, '*') AND regexp_replace(raw, '^\\*+\\s*', '') <> '' AS changed")

_FILES = [("AR_25-2_PROTECTION.pdf",), ("PAM_40-11.pdf",), ("DA_PAM_600-3.pdf",), ("ATP_6-22.1_X.pdf",), ("TC 1-19.30.PDF",), ("notes.pdf",), ("FM 6-02",)]


def _publication_sql(profile: P.Profile) -> str:
    base = "replace(CASE WHEN regexp_matches(name, '^\\.*[^.]*$') THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') END, '_', ' ')"
    number = "CASE " + " ".join(f"WHEN {duck.meets(base, p, 'i')} THEN {duck.q(prefix + ' ')} || regexp_extract({base}, {duck.rx(p, 'i')}, {g})" for p, g, prefix in profile.publications) + " END"
    return f"{number} AS publication, split_part({number}, ' ', 1) AS doc_type"


for _name, _profile, _rows in (("army_publications", ARMY, _FILES), ("dod_publications", DOD, [("DoDI_5000.02T.pdf",), ("DODM 4140.01 Vol 2.pdf",), ("DoDCPMIssuance 1400.25v771.pdf",), ("DoD CPM Issuance 1400.25 Vol 250.pdf",), ("CJCS Guide 3130.pdf",), ("CJCSI 3170.01I.pdf",), ("AI 40.pdf",), ("DTM-19-004.pdf",), ("DTM 19-004.pdf",), ("JP 3 0.pdf",), ("memo.pdf",)])):
    case(_name, "Publication numbers and kinds from file names.", _rows, "name string", lambda n, p=_profile: {"publication": T.publication_number(n, p), "doc_type": T.document_type(T.publication_number(n, p))}, _publication_sql(_profile))

case("publication_aliases", "Two names of one publication.", [("DA PAM 385-64",), ("PAM 385-64",), ("AR 5-1",)], "publication string", lambda p: {"canonical": T.canonical_publication(p)}, "regexp_replace(publication, '^DA PAM ', 'PAM ') AS canonical")

_HEADERS = [("Glossary",), ("GLOSSARY OF TERMS AND ACRONYMS",), ("see the Glossary for more",), ("Section II - Terms",), ("Terms and Abbreviations",), ("x\n  Glossary \ny",), ("PART II. DEFINITIONS",), ("G.2. DEFINITIONS",), ("Glossary of Maps",)]
case("header_cases", "Which pages have a glossary header.", _HEADERS, "page string", lambda p: {"army": p.rlike(java(P.any_of(ARMY.headers), "im")), "dod": p.rlike(java(P.any_of(DOD.headers), "im"))}, f"{duck.meets('page', P.any_of(ARMY.headers), 'im')} AS army, {duck.meets('page', P.any_of(DOD.headers), 'im')} AS dod")

_SECTIONS = [("Section I\n",), ("Section |",), ("Section l - Acronyms",), ("Section II",), ("Section Il Terms",), ("Section II policies",), ("Section III",), ("Section IV - Other",), ("Section lV",), ("Section VIII",), ("see Section II",)]
_ONE_SQL = f"({duck.meets('page', r'^\s*Section\s+[I|l](\s*$|\s+(—|–|-|Abbreviations|Acronyms))', 'im')})"
case("section_cases", "Section headers, with the misreadings of scanned pages.", _SECTIONS, "page string", lambda p: {"one": p.rlike(java(ARMY.section_one, "im")), "two": p.rlike(java(ARMY.section_two, "im")), "later": p.rlike(java(ARMY.section_after, "im"))}, f"{_ONE_SQL} AS one, {duck.meets('page', ARMY.section_two, 'im')} AS two, {duck.meets('page', ARMY.section_after, 'im')} AS later")

_LINES = [("UNCLASSIFIED copy",), ("pin 123456",), ("AR 25-2",), ("AR 124",), ("Glossary-4",), ("Table B2 shows",), ("part of the force",), ("William E",), ("GL-3",), ("command post",), ("08 May 2021",), ("U.S. Army",), ("This page intentionally left blank",), ("U.S. Code of",), ("...",), ("Change 2, 5/6/2020",)]
case("invalid_line_cases", "Lines that never belong to an entry.", _LINES, "line string", lambda c: {"army": c.rlike(java(ARMY.invalid_match(), "i")), "dod": c.rlike(java(DOD.invalid_match(), "i")), "army_footer": c.rlike(java(ARMY.footer_match(), "i")), "dod_footer": c.rlike(java(DOD.footer_match(), "i"))}, ", ".join(f"{duck.meets('line', p, 'i')} AS {n}" for n, p in (("army", ARMY.invalid_match()), ("dod", DOD.invalid_match()), ("army_footer", ARMY.footer_match()), ("dod_footer", DOD.footer_match()))))

_DEFS = [("A plan (AR 25-2, para 3) for use .",), ("Held per (DoDI 5000.02) rules.",), ("See Reference (k).",), ("(JP 3-0) Action taken.",), ("none",)]
case("citation_cases", "Citations within definitions.", _DEFS, "definition string", lambda d: {"army": T.strip_citations(d, ARMY.citation), "dod": T.strip_citations(d, DOD.citation)}, f"{duck.citations('definition', ARMY.citation)} AS army, {duck.citations('definition', DOD.citation)} AS dod")

_ACRONYMS = [("USAF air force",), ("U.S. code section",), ("III. The board",), ("DODD 6490.02E) and",), ("The Army",), ("M-1A1 tank",), ("A",), ("AIT advanced individual training that is much too long for a list of acronyms",)]
case("acronym_line_cases", "Lines of acronym lists.", _ACRONYMS, "line string", lambda c: {"acronym": T.is_acronym_line(c)}, "length(line) BETWEEN 1 AND 60 AND regexp_matches(split_part(line, ' ', 1), '^[A-Z][A-Z0-9.\\-]{1,14}$') AND (regexp_matches(split_part(line, ' ', 1), '[A-Z]\\.[A-Z]') OR NOT contains(substr(line, 1, 30), '.')) AS acronym")

case("bold_cases", "Bold spans, by flag or by font.", [(16, "Times"), (4, "Arial-BoldMT"), (0, "Helvetica Black"), (20, None), (None, None), (4, "Times")], "flags int, font string", lambda f, n: {"bold": T.is_bold(f, n)}, "(coalesce(flags, 0) & 16) > 0 OR regexp_matches(lower(coalesce(font, '')), 'bold|black|heavy') AS bold")

case("rounding_cases", "Heights are rounded half to even.", [(0.5,), (1.5,), (2.5,), (100.49,), (101.51,)], "y double", lambda y: {"bucket": F.bround(y, 0)}, "round_even(y::DOUBLE, 0) AS bucket")

case("range_relation_cases", "How two page ranges lie.", [(1, 4, 1, 4), (1, 4, 3, 8), (1, 2, 5, 6), (None, None, 2, 3), (2, 3, None, None), (None, None, None, None)], "a int, b int, c int, d int", lambda a, b, c, d: {"relation": D.range_relation(a, b, c, d)}, "CASE WHEN a IS NULL AND c IS NULL THEN 'neither' WHEN a IS NULL THEN 'second-only' WHEN c IS NULL THEN 'first-only' WHEN a = c AND b = d THEN 'exact' WHEN c <= b AND a <= d THEN 'overlap' ELSE 'disjoint' END AS relation")

case("jaccard_cases", "Overlap of definitions.", [("a plan for war", "A Plan"), ("", "x"), ("same words", "words same"), ("no", "yes")], "a string, b string", lambda a, b: {"overlap": F.round(T.token_jaccard(a, b), 6)}, "CASE WHEN trim(a) = '' OR trim(b) = '' THEN 0.0::DOUBLE ELSE round(len(list_intersect(string_split(lower(a), ' '), string_split(lower(b), ' '))) / len(list_distinct(list_concat(string_split(lower(a), ' '), string_split(lower(b), ' ')))), 6) END AS overlap")

case("checksum_cases", "Fetched files, held against the beginning of their checksum.", [("abc", "ba7816bf"), ("abc", "00"), ("", "e3b0c442")], "content string, prefix string", lambda c, p: {"good": T.checksum_matches(c.cast("binary"), p)}, "starts_with(sha256(content), prefix) AS good")

_PAIRS = [("SECARMY", "Secretary of the Army"), ("1LT", "first lieutenant"), ("11B", "infantryman by trade and name"), ("UNCLASSIFIED", "PIN 1"), ("COMMAND", "12 of these"), ("vol", "voluntary"), ("Vol", "volume"), ("see also", "something that is long enough"), ("a. first", "something that is long enough"), ("Terms", "something that is long enough"), ("training and", "something that is long enough"), ("x", "something that is long enough"), ("Pharmacy service (PS) (from rules)", "A service that fills orders."), ("1.2-3", "something that is long enough"), ("Force (AR", "something that is long enough"), ("Good phrase", "AR 25-2, para 3b"), ("Numbered $$$ ### term", "something that is long enough"), ("Real headword", "The meaning of the word in full."), ("", "x"), ("Word. Next", "something that is long enough"), ("Only digits", "1. 2. 3. 4. 5. 6. 7. 8")]


def _classify_sql(term: str, definition: str) -> str:
    t, d = duck.strip(term), duck.strip(definition)
    peeled = f"rtrim({t})"
    for _ in range(3):
        peeled = f"rtrim(regexp_replace({peeled}, '\\s*\\([^()]{{1,120}}\\)\\s*$', ''))"
    tokens = f"regexp_split_to_array({duck.strip(peeled)}, '\\s+')"
    tail = f"lower(rtrim({tokens}[-1], '.,;:'))"
    noun = f"(len({tokens}) <= 10 AND {peeled} <> '' AND NOT {duck.meets(peeled, r'\.\s+\S')} AND NOT {duck.meets(tail, '^' + C.NOUN_TAIL + '$')} AND length(regexp_replace({peeled}, '[^\\p{{L}}\\s/-]', '', 'g')) / greatest(length({peeled}), 1) >= 0.85)"
    rules = [
        (f"{t} = '' OR {d} = ''", "b"),
        (f"{t} IN ({', '.join(map(duck.q, C.NOISE))})", "b"),
        (f"length({t}) <= 22 AND {duck.meets(t, r'^[A-Z][A-Z0-9./-]{1,18}(\s*\([^)]{1,20}\))?$')} AND {duck.meets(d, r'^\p{L}')} AND length({d}) >= 3", "g"),
        (f"{duck.meets(t, r'^\d[A-Z]{2,3}$')} AND length({d}) >= 3", "g"),
        (duck.meets(t, "^[A-Z]{6,}$"), "b"),
        (duck.meets(f"lower({t})", "^(this section|see |pin )"), "b"),
        (f"length({d}) < 15 AND {duck.meets(t, '^[a-z]{2,5}$')} AND {duck.meets(d, '^[a-z][a-z ]{2,49}$')}", "g"),
        (f"length({d}) < 15", "b"),
        (duck.meets(t, r"^([abc]\. |\([1-5]\))"), "b"),
        (duck.meets(t, rf"\b{P.TAIL_STOP}$", "i"), "b"),
        (f"length({t}) < 2 OR length({t}) > 200 OR length({peeled}) > 100", "b"),
        (duck.meets(t, r"^[\d.,/ -]+$"), "b"),
        (duck.meets(t, r"\([A-Z]{2,5}\s*$|\(AR\b"), "b"),
        (f"NOT {noun}", "b"),
        (f"{duck.meets(d, r'^(AR|PAM|FM|ATP|ADP|TC|TM|SD|STP)[\s-]\d')} AND length({d}) < 25", "b"),
        (duck.meets(d, r"^[\d.)\s]+$"), "b"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + " ELSE 'g' END"


case("classify_cases", "Good entries and noise.", _PAIRS, "term string, definition string", lambda t, d: {"verdict": C.classify(t, d)}, _classify_sql("term", "definition") + " AS verdict")


# Evaluation


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(glossary_of(spark, sf_dir)).withColumnRenamed("doc_id", "pdf")


def _stored_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, extracted once for reports that read them several times."""
    return stored(_entries(spark, sf_dir), "entries")


_BEST = "WITH " + duck.entries(DOD)


@query(_BEST + f" SELECT doc_id AS pdf, 'glossary' AS source_type, term, {_classify_sql('term', 'definition')} AS verdict FROM best")
def entry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.verdicts(_entries(spark, sf_dir))


@query(_BEST + f", v AS (SELECT {_classify_sql('term', 'definition')} AS verdict FROM best) SELECT 'glossary' AS source_type, CAST(count(*) FILTER (WHERE verdict = 'g') AS BIGINT) AS g, CAST(count(*) FILTER (WHERE verdict = 'b') AS BIGINT) AS b FROM v")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.verdict_counts(evaluate.verdicts(_entries(spark, sf_dir)))


@query(_BEST + f""", v AS (SELECT doc_id AS pdf, page_idx, ord, term, {_classify_sql('term', 'definition')} AS verdict FROM best),
o AS (SELECT pdf, term, min(verdict) AS a FROM v WHERE page_idx = 0 GROUP BY ALL), n AS (SELECT pdf, term, min(CASE WHEN length(term) > 12 THEN 'b' ELSE verdict END) AS b FROM v WHERE ord > 1 GROUP BY ALL)
SELECT coalesce(o.pdf, n.pdf) AS pdf, 'glossary' AS source_type, coalesce(o.term, n.term) AS term, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN a = b THEN 'same' ELSE a || '->' || b END AS change FROM o FULL JOIN n ON o.pdf = n.pdf AND o.term = n.term""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots, the first without later pages, the second without first entries and with a stricter rule."""
    e = _stored_entries(spark, sf_dir)
    old, new = evaluate.verdicts(e.where("pdf_page_index = 1")), evaluate.verdicts(e.where("ord > 1"))
    return evaluate.snapshot_diff(old, new.withColumn("verdict", F.when(F.length("term") > 12, "b").otherwise(F.col("verdict"))))


def _labels(entries: DataFrame) -> DataFrame:
    """Labels made from entries by fixed rules, so that every case of the scorecards occurs."""
    n = F.length("term") % 4
    kind = F.when(n == 0, "negative_labels").otherwise("labels")
    definition = F.when(n == 1, F.col("definition")).otherwise(F.concat(F.col("term"), F.lit(" "), F.col("definition")))
    key = F.when(n == 3, F.concat(F.col("term_normalized"), F.lit(" x"))).otherwise(F.col("term_normalized"))
    doc_type = F.when(F.col("pdf").cast("bigint") % 2 == 0, "AR").otherwise("FM")
    return entries.select("pdf", doc_type.alias("doc_type"), kind.alias("kind"), key.alias("term_normalized"), definition.alias("definition"), "source_type")


_LABELS = ", lab AS (SELECT doc_id AS pdf, CASE WHEN CAST(doc_id AS BIGINT) % 2 = 0 THEN 'AR' ELSE 'FM' END AS doc_type, CASE WHEN length(term) % 4 = 0 THEN 'negative_labels' ELSE 'labels' END AS kind, CASE WHEN length(term) % 4 = 3 THEN term_normalized || ' x' ELSE term_normalized END AS term_normalized, CASE WHEN length(term) % 4 = 1 THEN definition ELSE term || ' ' || definition END AS d FROM best)"
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(%s), '\\s+'), lambda x: x <> ''))"


@query(_BEST + _LABELS + f""",
h AS (SELECT lab.*, best.definition AS f FROM lab LEFT JOIN best ON best.doc_id = lab.pdf AND best.term_normalized = lab.term_normalized),
pos AS (SELECT pdf, doc_type, count(f) AS tp, count(*) - count(f) AS fn, sum(CASE WHEN f IS NOT NULL THEN len(list_intersect({_TOKENS % 'f'}, {_TOKENS % 'd'})) / len(list_distinct(list_concat({_TOKENS % 'f'}, {_TOKENS % 'd'}))) END) AS ov FROM h WHERE kind = 'labels' GROUP BY ALL),
neg AS (SELECT pdf, count(DISTINCT term_normalized) FILTER (WHERE f IS NOT NULL) AS fp FROM h WHERE kind = 'negative_labels' GROUP BY pdf),
a AS (SELECT doc_type, sum(tp) AS tp, sum(fn) AS fn, sum(ov) AS ov, sum(coalesce(fp, 0)) AS fp, sum(CASE WHEN fp IS NULL THEN 0 ELSE tp END) AS tn, bool_or(fp IS NOT NULL) AS had FROM pos LEFT JOIN neg USING (pdf) GROUP BY doc_type),
s AS (SELECT *, tp / (tp + fn) AS r, CASE WHEN had THEN tn / (tn + fp) END AS p, ov / tp AS j, CASE doc_type WHEN 'AR' THEN 0.95 ELSE 0.85 END AS mp, CASE doc_type WHEN 'AR' THEN 0.85 ELSE 0.75 END AS mr FROM a)
SELECT doc_type, 'glossary' AS source_type, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp_explicit, CAST(tn AS BIGINT) AS tp_in_negative_docs, had AS had_negatives, round(r, 3) AS recall, round(p, 3) AS "precision", round(j, 3) AS def_jaccard, r >= mr AND j >= mr AND coalesce(p >= mp, true) AS passed FROM s""")
def label_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and definition overlap against labels."""
    e = _stored_entries(spark, sf_dir)
    return evaluate.scorecard(_labels(e), e)


@query(_BEST + _LABELS + " SELECT pdf, term_normalized FROM lab WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.doc_id = lab.pdf AND best.term_normalized = lab.term_normalized)")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored_entries(spark, sf_dir)
    return evaluate.missing_labels(_labels(e), e).select("pdf", "term_normalized")


@query(_BEST + _LABELS + " SELECT pdf, term_normalized FROM lab WHERE EXISTS (SELECT 1 FROM best WHERE best.doc_id = lab.pdf AND best.term_normalized = lab.term_normalized)")
def met_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stored_entries(spark, sf_dir)
    return evaluate.met_labels(_labels(e), e).select("pdf", "term_normalized")


@query(_BEST + f""", v AS (SELECT doc_id AS pdf, term, term_normalized, {_classify_sql('term', 'definition')} AS verdict FROM best),
k AS (SELECT pdf, CASE WHEN CAST(pdf AS BIGINT) % 3 = 0 THEN 1 ELSE 2 END AS tier, verdict = 'g' AS good, CASE WHEN length(term) % 5 = 0 THEN term_normalized || ' x' ELSE term_normalized END AS t FROM v),
u AS (SELECT k.*, EXISTS (SELECT 1 FROM best WHERE best.doc_id = k.pdf AND best.term_normalized = k.t) AS hit FROM k WHERE NOT (CAST(pdf AS BIGINT) % 7 = 0 AND NOT (tier = 1 AND good))),
g AS (SELECT tier, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND hit) AS p, count(*) FILTER (WHERE NOT good AND hit) AS neg FROM u GROUP BY tier)
SELECT CAST(tier AS INTEGER) AS tier, CAST(n AS BIGINT) AS positive_total, CAST(p AS BIGINT) AS positive_present, round(CASE WHEN n > 0 THEN p / n ELSE 1 END, 3) AS positive_recall, CAST(neg AS BIGINT) AS negative_violations, CASE WHEN tier = 1 THEN neg = 0 AND (n = 0 OR p / n >= 0.95) END AS passed FROM g""")
def tier_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed and automatic labels; every seventh document fell back to the old gate."""
    e = _stored_entries(spark, sf_dir)
    n = F.col("pdf").cast("bigint")
    good = C.classify(F.col("term"), F.col("definition")) == "g"
    kind = F.when(n % 3 == 0, F.when(good, "tier1_positive_terms").otherwise("negative_labels")).otherwise(F.when(good, "auto_positive_labels").otherwise("auto_negative_labels"))
    key = F.when(F.length("term") % 5 == 0, F.concat("term_normalized", F.lit(" x"))).otherwise(F.col("term_normalized"))
    labels = e.select("pdf", kind.alias("kind"), key.alias("term_normalized"), "source_type")
    return evaluate.tier_scorecard(labels, e, e.where(n % 7 == 0).select("pdf"))


@query("SELECT t.source AS doc_type, t.want, CAST(coalesce(n, 0) AS BIGINT) AS have, coalesce(n, 0) >= t.want AS enough FROM (VALUES ('src0', 40), ('src1', 60), ('none', 1)) AS t(source, want) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) USING (source)")
def stratification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether enough documents of each kind are there."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_type"))
    return evaluate.stratification(docs, literal(spark, [("src0", 40), ("src1", 60), ("none", 1)], "doc_type string, want int"))


@query(_BEST + """, a AS (SELECT doc_id AS pdf, count(*) AS n, max(page_idx) + 1 AS last FROM best GROUP BY doc_id), g AS (SELECT pdf, n + CASE WHEN CAST(pdf AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS n, last FROM a UNION ALL SELECT 'gone', 1, 1)
SELECT g.pdf, CASE WHEN a.pdf IS NULL THEN 'missing' ELSE 'n' END AS changed FROM g LEFT JOIN a USING (pdf) WHERE (a.pdf IS NULL OR g.n <> a.n) AND NOT coalesce(TRY_CAST(g.pdf AS BIGINT) % 10 = 0, false)""")
def golden_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose result left the recorded one, without the accepted deviations."""
    a = _stored_entries(spark, sf_dir).groupBy("pdf").agg(F.count("*").alias("n"), F.max("pdf_page_index").alias("last"))
    n = F.expr("try_cast(pdf AS bigint)")
    golden = a.select("pdf", (F.col("n") + F.when(n % 5 == 0, 1).otherwise(0)).alias("n"), "last").union(literal(a.sparkSession, [("gone", 1, 1)], "pdf string, n bigint, last int"))
    found = evaluate.golden_diff(a, golden, golden.where(n % 10 == 0), "pdf", ["n", "last"])
    return found.select("pdf", F.array_join("changed", ",").alias("changed"))


@query("WITH q AS (SELECT doc_id AS document_id, CASE WHEN doc_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, 'v1' AS extractor_version, doc_id % 3 AS entry_count FROM documents) SELECT q.document_id, d.source AS canonical_id, d.lang AS gcs_key FROM q JOIN documents d ON d.doc_id = q.document_id WHERE q.status = 'SUCCEEDED' AND q.extractor_version = 'v1' AND q.entry_count = 0 AND (d.text || ' Glossary') ILIKE '%glossary%' AND length(d.text || ' Glossary') > 1000 AND d.n_chars // 100 >= 10")
def failing_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that ought to have had entries."""
    queue, docs = _queue(table(spark, sf_dir, "documents"))
    return evaluate.failing_cohort(queue, docs, "v1", 1000, 10)


def _queue(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = F.col("doc_id")
    queue = docs.select(n.alias("document_id"), F.when(n % 4 == 0, "FAILED").otherwise("SUCCEEDED").alias("status"), F.lit("v1").alias("extractor_version"), (n % 3).cast("int").alias("entry_count"), F.lit(2).alias("attempts"))
    text = F.concat("text", F.lit(" Glossary"))
    return queue, docs.select(n.alias("id"), F.col("source").alias("canonical_id"), F.col("lang").alias("gcs_key"), F.lit("HAS_TEXT").alias("extracted_text_status"), text.alias("extracted_text"), F.floor(F.col("n_chars") / 100).alias("page_count"))


@query("SELECT doc_id AS document_id, CASE WHEN a THEN 'PENDING' WHEN doc_id % 4 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, CASE WHEN a THEN NULL ELSE 'v1' END AS extractor_version, CAST(doc_id % 3 AS INTEGER) AS entry_count, CASE WHEN a THEN 0 ELSE 2 END AS attempts FROM (SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 3 = 0 AND length(text) + 9 > 1000 AS a FROM documents)")
def requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction queue with that cohort put back."""
    queue, docs = _queue(table(spark, sf_dir, "documents"))
    return evaluate.requeued(queue, docs, "v1", 1000)


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, doc_id FROM documents WHERE n_chars > 2000 UNION SELECT lang, doc_id FROM documents WHERE source = 'src0') GROUP BY lang")
def cohort_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars", "source")
    return docs.where("n_chars > 2000").select("lang", "doc_id").union(docs.where("source = 'src0'").select("lang", "doc_id")).distinct().groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT d.doc_id, coalesce(a.quality, b.quality) AS quality, a.quality IS NOT NULL AS direct FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1")
def two_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up by one key, else by another: how manifests are joined."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    a, b = labels.select("doc_id", F.col("quality").alias("qa")), labels.select((F.col("doc_id") - 1).alias("doc_id"), F.col("quality").alias("qb"))
    return docs.join(a, "doc_id", "left").join(b, "doc_id", "left").select("doc_id", F.coalesce("qa", "qb").alias("quality"), F.col("qa").isNotNull().alias("direct"))


@query("SELECT b.item_id, CAST(count(d.doc_id) AS BIGINT) AS n FROM (SELECT item_id, split_part(text, ' ', 1) AS p FROM benchmark) b LEFT JOIN documents d ON starts_with(d.text, p) GROUP BY b.item_id")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts begin with each of a set of prefixes, of whatever length."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("p"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    met = evaluate.prefix_matches(docs, "text", items.select("p").distinct(), "p").groupBy("p").agg(F.count("doc_id").alias("n"))
    return items.join(met, "p", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH " + duck.pages() + ", " + duck.ranges(SYNTHETIC).lstrip() + f""",
t2 AS (SELECT x.doc_id, min(p.page_idx) AS i2 FROM span x JOIN page p ON p.doc_id = x.doc_id AND p.page_idx BETWEEN x.s AND x.e WHERE {duck.meets('p.text', SYNTHETIC.section_two, 'im')} GROUP BY x.doc_id)
SELECT CASE WHEN x.doc_id IS NULL THEN 'missing_trace' WHEN t2.i2 IS NOT NULL THEN 'B_narrowed_partial_benefit' ELSE 'A_full_range_direct_target' END AS target_group, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id FROM page) d LEFT JOIN span x USING (doc_id) LEFT JOIN t2 USING (doc_id) GROUP BY 1""")
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what narrowing to a section does to them."""
    pages = readers.text_pages(table(spark, sf_dir, "documents"))
    found = ranges.sections(pages, ranges.glossary_ranges(pages, SYNTHETIC), SYNTHETIC).select("doc_id", "section_structure", "narrowing_fired")
    rows = pages.select("doc_id").distinct().join(found, "doc_id", "left").withColumnRenamed("doc_id", "document_id")
    return evaluate.section_groups(rows).groupBy("target_group").agg(F.count("*").alias("n"))
