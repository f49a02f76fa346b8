"""Queries for what reads, writes and reports: sources, sinks, dumps, ranges and label sets.

Those over literal rows have their expected results as SQL values, worked out by hand and not by the patterns under test.
"""

from __future__ import annotations

import json

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import duck
from .functions import diagnose as D
from .functions.patterns import ARMY, DOD
from .operators import evaluate, layout, ranges, segment
from .operators.dedup import dedupe
from .plans import pipeline
from .queries import _classify_sql, glossary_of, literal, payload_rows, query, table, values
from .sources import readers, writers
from .sources.shared import new_folder


def folder_with(spark: SparkSession, files: dict[str, str]) -> str:
    """A new folder in the shared one, with these files."""
    at = new_folder(spark, "files")
    where, path = FileSystem.from_uri(writers.address(at))
    for name, text in files.items():
        where.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
        with where.open_output_stream(f"{path}/{name}") as f:
            f.write(text.encode())
    return at


# Sources

FILES = {"a.pdf": "one", "deep/er/b.pdf": "two", "deep/c.txt": "three", "d.PDF": "four"}


@query("SELECT name AS filename, CAST(length(content) AS BIGINT) AS length, sha256(content) AS hash FROM " + values([("a.pdf", "one"), ("b.pdf", "two")], "name, content"))
def corpus_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PDFs of a folder and all below it; the suffix is matched as written."""
    return readers.corpus_files(spark, folder_with(spark, FILES)).select("filename", "length", F.sha2("content", 256).alias("hash"))


@query("SELECT * FROM " + values([("a.pdf", "bucket/a", "7"), ("b.pdf", None, "8"), ("c.txt", "bucket/c", None), ("d.PDF", None, None)], "filename, gcs_key, doc_id"))
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and ids by absolute path, else by path below the root; an empty entry counts as none."""
    root = folder_with(spark, FILES)
    plain = root.removeprefix("file:").replace("//", "/")
    entries = {f"{plain}/a.pdf": {"gcs_key": "bucket/a", "doc_id": "7"}, "a.pdf": {"gcs_key": "no"}, "deep/er/b.pdf": {"doc_id": "8"}, f"{plain}/deep/c.txt": {}, "deep/c.txt": {"gcs_key": "bucket/c"}}
    manifest = readers.read_manifest(spark, folder_with(spark, {"manifest.json": json.dumps(entries)}))
    return readers.with_manifest(readers.corpus_files(spark, root, "*"), manifest, plain).select("filename", "gcs_key", "doc_id")


@query("SELECT r_regionkey, r_name FROM region")
def commented_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as CSV behind lines of comment."""
    rows = [f"{r['r_regionkey']},{r['r_name']}" for r in table(spark, sf_dir, "region").collect()]
    at = folder_with(spark, {"region.csv": "\n".join(["# made by hand", "# not the header", "r_regionkey,r_name", *rows])})
    return readers.read_commented_csv(spark, at, "r_regionkey int, r_name string")


@query("SELECT * FROM nation")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as a snapshot with tabs, and read again."""
    nation, at = table(spark, sf_dir, "nation"), new_folder(spark, "tsv")
    writers.write_snapshot(nation, at, "\t")
    return readers.read_tsv(spark, at, ", ".join(f"{n} {t}" for n, t in nation.dtypes))


LABELS = """
documents:
  - pdf: AR_1.pdf
    doc_type: AR
    labels: [{term: Area, definition: A place., source_type: inline}]
    negative_labels: [{term: Noise}]
  - pdf: FM_2.pdf
    auto_positive_labels: [{term: Base, definition: A locality.}]
"""


@query("SELECT * FROM " + values([("AR_1.pdf", "AR", "labels", "Area", "A place.", "inline"), ("AR_1.pdf", "AR", "negative_labels", "Noise", None, "glossary"), ("FM_2.pdf", None, "auto_positive_labels", "Base", "A locality.", "glossary")], "pdf, doc_type, kind, term, definition, source_type"))
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_labels(spark, folder_with(spark, {"labels.yaml": LABELS}) + "/labels.yaml")


@query("SELECT 'sha256:' || sha256(string_agg(lpad(CAST(doc_id AS VARCHAR), 12, '0') || text, '' ORDER BY doc_id)) AS corpus_hash FROM documents")
def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of all names and contents, in the order of names."""
    docs = table(spark, sf_dir, "documents")
    return evaluate.corpus_hash(docs.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.col("text").cast("binary").alias("content")), "name", "content")


@query("WITH " + duck.entries(DOD) + f" SELECT 'doc' || doc_id || '.pdf' AS pdf, 'glossary' AS source_type, term, {_classify_sql('term', 'definition')} AS verdict FROM best")
def candidate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the entries of output documents that were written, a file each, and read again."""
    payload, at = payload_rows(spark, sf_dir), new_folder(spark, "candidates")
    writers.write_documents(payload.where(F.size("entries") > 0), at)
    return evaluate.verdicts(evaluate.candidate_entries(readers.read_candidates(spark, at)))


# Dumps

_span = lambda text, x, y, flags=4, font="Roman": {"text": text, "bbox": [x, y, x + 50.0, y + 10.0], "font": font, "flags": flags}
_page = lambda text, label=None, spans=(), error=False: {"text": text, "height": 792.0, "label": label, "read_error": error, "blocks": [{"lines": [{"spans": line} for line in spans]}]}
_LONG = " words" * 30
DUMPS = [
    {"doc_id": "army", "filename": "AR_25-2.pdf", "pages": [
        _page("Cover" + _LONG, ""),
        _page("Glossary\nSection I\nAbbreviations" + _LONG, "G-1", [[_span("AIT", 72.0, 200.0), _span("advanced individual training", 150.0, 200.0)]]),
        _page("Section II\nTerms" + _LONG, "G-2", [
            [_span("above the header", 72.0, 160.0, 16)], [_span("Section II", 72.0, 180.0, 16)],
            [_span("Acceptance", 72.0, 200.0, 16)], [_span("The formal approval of a product by the user.", 90.0, 214.0)],
            [_span("*Access", 72.0, 228.0, 16), _span("control", 110.0, 228.0, 16), _span("Granting or denying", 150.0, 228.0)], [_span("of requests.", 90.0, 242.0)],
            [_span("Glossary-2", 72.0, 780.0)], [_span("   ", 72.0, 300.0)],
        ]),
        _page(None, None, [[_span("lost", 72.0, 200.0, 16)]], True),
    ]},
    {"doc_id": "plain", "filename": "FM 6-02.pdf", "pages": [_page("Glossary\n" + _LONG, None, [
        [_span("Terrain", 72.0, 200.0)], [_span("The ground as the user finds it on the day.", 110.0, 214.0)], [_span("Weather", 72.0, 228.0)], [_span("The state of the sky as the user finds it.", 110.0, 242.0)],
    ])]},
    {"doc_id": "scan", "filename": "notes.pdf", "pages": [_page("x", None)]},
]


def dumps(spark: SparkSession) -> DataFrame:
    return readers.read_dumps(spark, folder_with(spark, {"dumps.json": "\n".join(map(json.dumps, DUMPS))}))


@query("SELECT * FROM " + values([("army", 0, None, False), ("army", 1, "G-1", False), ("army", 2, "G-2", False), ("army", 3, None, True), ("plain", 0, None, False), ("scan", 0, None, False)], "doc_id, page_idx, label, read_error"))
def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of nested dumps; an empty label is none."""
    return layout.pages_of(dumps(spark)).select("doc_id", "page_idx", "label", "read_error")


@query("SELECT * FROM " + values([("army", 1, 2, 1), ("army", 2, 9, 7), ("plain", 0, 4, 4)], "doc_id, page_idx, n_spans, n_lines"))
def dump_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of nested dumps that are not blank, of pages that could be read."""
    spans = layout.spans_of(dumps(spark))
    return spans.groupBy("doc_id", "page_idx").agg(F.count("*").cast("int").alias("n_spans"), F.count_distinct("block", "line").cast("int").alias("n_lines"))


_PAYLOAD = [
    ("army", "AR 25-2", "AR", "both", True, False, "2,3,4", "3,4", 1, "Acceptance=The formal approval of a product by the user.|Access control=Granting or denying of requests."),
    ("plain", "FM 6-02", "FM", "none", False, True, "1", None, 0, "Terrain=The ground as the user finds it on the day.|Weather=The state of the sky as the user finds it."),
    ("scan", None, None, "unknown", False, False, "", None, 0, ""),
]


@query("SELECT * FROM " + values(_PAYLOAD, "source_doc_id, publication, doc_type, section_structure, narrowing_fired, legacy_fallback, glossary_pages, section_ii_pages, scan_errors, entries"))
def dump_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over dumps: two sections of which the second counts, an unreadable page, a range without bold lines that
    falls back to place alone, and a document without a text layer."""
    d = dumps(spark)
    docs = d.select("doc_id", "filename", F.lit(None).cast("string").alias("gcs_key"))
    out = pipeline.payloads(docs, layout.pages_of(d), layout.spans_of(d), ARMY)
    m = F.col("metadata")
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return out.select(
        "source_doc_id", F.col("source_pub_number").alias("publication"), F.col("source_doc_type").alias("doc_type"), m["section_structure"].alias("section_structure"), m["section_ii_narrowing_fired"].alias("narrowing_fired"),
        m["glossary_used_legacy_fallback"].alias("legacy_fallback"), joined(m["glossary_pages"]).alias("glossary_pages"), joined(m["section_ii_pages"]).alias("section_ii_pages"), m["section_ii_boundary_scan_errors"].cast("int").alias("scan_errors"),
        F.array_join(F.transform("entries", lambda e: F.concat_ws("=", e["term"], e["definition"])), "|").alias("entries"),
    )


@query("SELECT * FROM " + values([("d", 0, 100.0, "see the glossary below"), ("d", 1, 140.0, "GLOSSARY")], "doc_id, page_idx, y_pos, line_text"))
def top_zone_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in the head of a page that speak of a glossary; spans of one line are joined, and its first says where it is."""
    rows = [("d", 0, 0, 0, 0, "see the", 10.0, 100.0), ("d", 0, 0, 0, 1, "glossary below", 60.0, 170.0), ("d", 0, 1, 0, 0, "glossary", 10.0, 150.0), ("d", 0, 2, 0, 0, "something else", 10.0, 90.0), ("d", 1, 0, 0, 0, "GLOSSARY", 10.0, 140.0)]
    return layout.top_zone_lines(literal(spark, rows, "doc_id string, page_idx int, block int, line int, span int, text string, x0 double, y0 double"))


def _lines(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    span = F.struct(F.col("x").alias("x0"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.col("y").alias("y0"), F.col("text"), F.col("bold"))
    df = literal(spark, rows, "doc_id string, page_idx int, y double, x double, bold boolean, text string")
    return df.select("doc_id", "page_idx", "y", F.array(span).alias("spans"), F.lit(792.0).alias("height"), F.lit(None).cast("string").alias("label"))


@query("SELECT * FROM " + values([("many", 0, 6)], "doc_id, page_idx, n_footers"))
def footer_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on which more than five lines go as footers."""
    rows = [(d, 0, 700.0 + i, 72.0, False, str(i + 1)) for d, n in (("many", 6), ("few", 5)) for i in range(n)]
    out = segment.footer_warnings(_lines(spark, rows), DOD)
    return out.select("doc_id", "page_idx", F.col("n_footers").cast("int").alias("n_footers"))


@query("SELECT * FROM " + values([("Alpha", "Alpha is the first letter. in the body of the page"), ("Bravo", "Bravo is the second letter of them.")], "term, definition"))
def body_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines that go on with a definition only those in the body of the page count."""
    rows = [("d", 0, 120.0, 72.0, False, "running head"), ("d", 0, 200.0, 72.0, False, "Alpha. Alpha is the first letter."), ("d", 0, 210.0, 72.0, False, "in the body of the page"), ("d", 0, 220.0, 72.0, False, "Bravo. Bravo is the second letter of them."), ("d", 0, 710.0, 72.0, False, "running foot")]
    return segment.glossary_entries(_lines(spark, rows), DOD).select("term", "definition")


# Ranges


def _pages(spark: SparkSession, docs: dict[str, list[str | None]]) -> DataFrame:
    rows = [(d, i, t, 792.0, None, t is None) for d, texts in docs.items() for i, t in enumerate(texts)]
    return literal(spark, rows, "doc_id string, page_idx int, text string, height double, label string, read_error boolean")


@query("SELECT * FROM " + values([("two", 2, 2, 5)], "doc_id, first_pages, second_pages, combined"))
def gap_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of header pages with one page between: long enough to be text, and together the largest block of five pages."""
    head, text = "Glossary\nterms", "x" * 200
    docs = {"two": [head, head, text, head, head], "short": [head, head, "x" * 199, head, head], "small": [head, text, head], "wide": [head, head, text, text, head, head]}
    found = ranges.gap_findings(_pages(spark, docs), ARMY)
    return found.select("doc_id", *(F.col(c).cast("int").alias(c) for c in ("first_pages", "second_pages", "combined")))


_CONTENTS = "Contents\nGlossary\n....... 9\n" + "Chapter ..... 1\n" * 5


@query("SELECT * FROM " + values([("plain", 1, 2), ("contents", 2, 3), ("unread", 1, 1)], "doc_id, start, end").replace("end)", '"end")'))
def loose_range_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first loosely written header that is not in a table of contents to the page before the next end mark."""
    docs = {"plain": ["intro", "x\n  glossary of terms \nA", "more", "\nReferences\n"], "contents": ["front", _CONTENTS, "\nGlossary\nA", "last"], "unread": [None, "\nGlossary\n", "\nIndex\n"], "none": ["see the glossary for more"]}
    found = ranges.loose_ranges(_pages(spark, docs))
    return found.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("SELECT * FROM " + values([("confirmed", 1, 2), ("leaders", 3, 4)], "doc_id, start, end").replace("end)", '"end")'))
def confirmed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header counts where at least three lines read like terms, and no more than two runs are dot leaders, up to two pages on."""
    terms = "G.2. DEFINITIONS\nAlpha. The first.\nBravo. The second.\n"
    docs = {
        "confirmed": ["front", terms, "Charlie. The third.\n"],
        "few": ["front", "GLOSSARY\nAlpha. The first.\nBravo. The second.\n", "no term here"],
        "leaders": [terms + "Charlie. The third.\n" + "Delta ...... 1\n" * 3, "x", "x", terms, "Echo. The fifth.\n"],
    }
    found = ranges.glossary_ranges(_pages(spark, docs), DOD)
    return found.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("SELECT doc_id, '-- 2 of 4 --' || text || '-- 3 of 4 --' || source AS middle, '-- 4 of 4 --' || lang AS tail, text AS unmarked FROM documents")
def page_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to a range of pages by the marks between them."""
    docs = table(spark, sf_dir, "documents")
    whole = F.concat(F.lit("-- 1 of 4 --front"), F.lit("-- 2 of 4 --"), "text", F.lit("-- 3 of 4 --"), "source", F.lit("-- 4 of 4 --"), "lang")
    cut = lambda c, a, b: D.page_slice(c, F.lit(a), F.lit(b))
    return docs.select("doc_id", cut(whole, 2, 3).alias("middle"), cut(whole, 4, 9).alias("tail"), cut(F.col("text"), 2, 3).alias("unmarked"))


# Label sets and reports


@query("SELECT * FROM " + values([("AR_1_x.pdf", "tier1_positive_terms", "acceptance"), ("AR_1_x.pdf", "negative_labels", "wrongly good"), ("AR_1_x.pdf", "tier1_positive_terms", "COMMAND"), ("AR_1_x.pdf", "negative_labels", "PINNED"), ("FM_2.pdf", "auto_positive_labels", "acceptance"), ("FM_2.pdf", "auto_negative_labels", "COMMAND")], "pdf, kind, term"))
def label_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from verdicts, and in documents that a reader went through from what that reader said."""
    text = "the formal approval of a product by the user"
    noise = "12 of these products by the user"
    names = {"AR_1_x.pdf": ("acceptance", "wrongly good", "COMMAND", "PINNED", "left out"), "FM_2.pdf": ("acceptance", "COMMAND")}
    rows = [(pdf, "glossary", t, noise if t.isupper() else text) for pdf, terms in names.items() for t in terms]
    entries = literal(spark, rows, "pdf string, source_type string, term string, definition string")
    overrides = literal(spark, [("AR_1", "wrongly good", "to_bad"), ("AR_1_x", "COMMAND", "to_good"), ("AR_1", "left out", "exclude"), ("FM_2", "COMMAND", "to_good"), ("AR_12", "acceptance", "to_bad")], "prefix string, term string, action string")
    reviewed = literal(spark, [("AR_1",), ("AR_1_",)], "prefix string")
    return evaluate.build_labels(entries, overrides, reviewed).select("pdf", "kind", "term")


@query("SELECT * FROM " + values([("AR_1.pdf", "both", True, 12, 10, 2), ("FM_2.pdf", "none", False, 3, None, None)], "pdf, section_structure, fired, entry_count, baseline_count, delta"))
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry counts against those of a baseline, whose file names begin with the document's; the first by name counts."""
    payload = literal(spark, [("AR_1.pdf", "both", True, 12), ("FM_2.pdf", "none", False, 3)], "pdf string, section_structure string, fired boolean, entry_count int")
    return evaluate.section_distribution(payload, literal(spark, [("AR_1_b.json", 4), ("AR_1.json", 10), ("FM_1.json", 9)], "source_pdf string, n int"))


@query("SELECT * FROM " + values([("good.pdf", "ok", None), ("empty.pdf", "no-defs", None), ("long.pdf", "fail", "schema: term"), ("lost.pdf", "fail", "cannot open")], "source_pdf, status, message"))
def status_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes as the reports list them, with the files that could not be decoded, next to the documents without one."""
    base = payload_rows(spark, sf_dir).limit(0)
    entry = lambda term: (term, term.lower(), "A definition.", "glossary", "Glossary", 1, None, 0.95, [])
    rows = [(name, entries) for name, entries in (("good.pdf", [entry("Term")]), ("empty.pdf", []), ("long.pdf", [entry("t" * 501)[:1] + entry("t")[1:]]))]
    made = spark.createDataFrame([("1", name, "1.0.0", "", "0" * 64, entries) for name, entries in rows], f"schema_version string, source_pdf string, extractor_version string, profile string, text_sha256 string, entries {base.schema['entries'].dataType.simpleString()}")
    payload = base.unionByName(made.withColumn("metadata", F.struct(F.lit("none").alias("section_structure"), F.array().cast("array<int>").alias("glossary_pages"))), allowMissingColumns=True)
    at = new_folder(spark, "reports")
    writers.write_reports(payload, at, literal(spark, [("lost.pdf", "cannot open")], "source_pdf string, message string"))
    listed = [spark.read.text(f"{at}/{name}").select(F.split("value", "\t").alias("v"), F.lit(status).alias("status")) for name, status in (("NO_DEFINITIONS", "no-defs"), ("FAILURES", "fail"))]
    reported = listed[0].union(listed[1]).select(F.col("v")[0].alias("source_pdf"), "status", F.try_element_at("v", F.lit(2)).alias("message"))
    return reported.union(pipeline.statuses(payload).where("status = 'ok'").select("source_pdf", "status", "message"))
