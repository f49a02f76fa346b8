"""What can be read: PDF corpora, layout dumps, plain texts, web pages, candidate outputs, manifests, label sets and tables."""

from __future__ import annotations

from pathlib import Path

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import java
from ..operators.layout import DUMP_SCHEMA

LINES_PER_PAGE, LEFT, TOP, LEADING, HEIGHT = 30, 72.0, 200.0, 14.0, 792.0
CANDIDATE_SCHEMA = (
    "schema_version string, source_pdf string, source_gcs_key string, source_doc_id string, source_pub_number string, source_doc_type string, extractor_version string, profile string, text_sha256 string, "
    "entries array<struct<term:string,term_normalized:string,definition:string,source_type:string,section:string,pdf_page_index:int,printed_page_label:string,confidence:double,flags:array<string>>>, "
    "metadata struct<total_pages:int,glossary_pages:array<int>,text_layer_present:boolean,entries_glossary:int,entries_inline:int,entries_after_dedup:int,glossary_used_legacy_fallback:boolean,section_structure:string,section_ii_pages:array<int>,section_ii_narrowing_attempted:boolean,section_ii_narrowing_fired:boolean,section_ii_boundary_scan_errors:int>"
)


def corpus_files(spark: SparkSession, path: str, suffix: str = "*.pdf") -> DataFrame:
    """(path, filename, length, content) of a folder and all below it, or of one file; the suffix is matched as written."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix)
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def with_manifest(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """files with gcs_key and doc_id from manifest (local, gcs_key, doc_id): by absolute path, else by path below root.

    An entry with neither key nor id counts as none.
    """
    used = manifest.where("gcs_key IS NOT NULL OR doc_id IS NOT NULL").groupBy("local").agg(F.first("gcs_key").alias("gcs_key"), F.first("doc_id").alias("doc_id"))
    plain = F.regexp_replace("path", "^file:/+", "/")
    below = F.regexp_replace(plain, "^" + _quoted(root.rstrip("/") + "/"), "")
    both = files.withColumn("absolute", plain).withColumn("relative", below)
    for side, key in (("a", "absolute"), ("r", "relative")):
        both = both.join(used.select(F.col("local").alias(key), F.struct("gcs_key", "doc_id").alias(side)), key, "left")
    entry = F.coalesce("a", "r")
    return both.select(*files.columns, entry["gcs_key"].alias("gcs_key"), entry["doc_id"].alias("doc_id"))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(local, gcs_key, doc_id) of a JSON map from path to key and id."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,struct<gcs_key:string,doc_id:string>>")
    return raw.select(F.explode(parsed).alias("local", "m")).select("local", "m.gcs_key", "m.doc_id")


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Layout dumps, one JSON document to a line (see layout.DUMP_SCHEMA)."""
    return spark.read.schema(DUMP_SCHEMA).json(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Output documents, one to a file."""
    return spark.read.schema(CANDIDATE_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def read_commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(pdf, doc_type, kind, term, definition, source_type) of a label file in YAML: a file of the size of a hand's work."""
    import yaml

    where, at = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{Path(path).resolve()}")
    with where.open_input_stream(at) as f:
        payload = yaml.safe_load(f.read().decode()) or {}
    kinds = ("labels", "negative_labels", "tier1_positive_terms", "auto_positive_labels", "auto_negative_labels")
    rows = [(d["pdf"], d.get("doc_type"), kind, x["term"], x.get("definition"), x.get("source_type", "glossary")) for d in payload.get("documents", []) for kind in kinds for x in d.get(kind) or []]
    return spark.createDataFrame(rows, "pdf string, doc_type string, kind string, term string, definition string, source_type string")


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = LINES_PER_PAGE) -> DataFrame:
    """lines(doc_id, page_idx, y, spans, height, label) of plain texts, laid out as pages of so many lines."""
    one = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("n", "raw"))
    line = one.select("doc_id", F.floor(F.col("n") / per_page).cast("int").alias("page_idx"), (F.lit(TOP) + LEADING * (F.col("n") % per_page)).alias("y"), T.strip(F.col("raw")).alias("text")).where("text <> ''")
    span = F.struct(F.lit(LEFT).alias("x0"), F.lit(0).alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), F.col("y").alias("y0"), F.col("text"), F.lit(False).alias("bold"))
    return line.select("doc_id", "page_idx", "y", F.array(span).alias("spans"), F.lit(HEIGHT).alias("height"), F.lit(None).cast("string").alias("label"))


def text_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_page: int = LINES_PER_PAGE) -> DataFrame:
    """pages(doc_id, page_idx, text, height, label, read_error) of plain texts."""
    lines = F.split(text_col, "\n", -1)
    n = F.ceil(F.size(lines) / per_page).cast("int")
    one = docs.select(F.col(id_col).cast("string").alias("doc_id"), lines.alias("lines"), F.explode(F.sequence(F.lit(0), n - 1)).alias("page_idx"))
    text = F.array_join(F.slice("lines", F.col("page_idx") * per_page + 1, F.lit(per_page)), "\n")
    return one.select("doc_id", "page_idx", text.alias("text"), F.lit(HEIGHT).alias("height"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("read_error"))


_TAGS = "h1|title|li|p|b|nav|footer"
_ELEMENT = rf"<({_TAGS})(?:\s[^>]*)?>([^<]*)"


def html_spans(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """spans of web pages: the text that follows each tag of a few kinds, laid out line by line.

    Headings, titles and <b> are bold, list items are indented, <nav> lies in the head and <footer> in the foot of a page.
    """
    kinds, texts = (F.regexp_extract_all(html_col, F.lit(java(_ELEMENT, "i")), F.lit(g)) for g in (1, 2))
    one = pages.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.arrays_zip(kinds.alias("kind"), texts.alias("text"))).alias("n", "e"))
    flat = one.select("doc_id", "n", F.lower("e.kind").alias("kind"), T.strip(T.squeeze(F.col("e.text"))).alias("text")).where("text <> ''")
    kind = F.col("kind")
    y = F.when(kind == "nav", 100.0).when(kind == "footer", 720.0).otherwise(F.lit(TOP) + LEADING * (F.col("n") % LINES_PER_PAGE))
    x: Column = F.when(kind == "li", LEFT + 40.0).when(kind == "b", LEFT + 10.0).otherwise(F.lit(LEFT))
    flags = F.when(kind.isin("h1", "title", "b"), 16).otherwise(4)
    return flat.select("doc_id", F.floor(F.col("n") / LINES_PER_PAGE).cast("int").alias("page_idx"), F.col("n").alias("block"), F.lit(0).alias("line"), F.lit(0).alias("span"), "text", x.alias("x0"), y.alias("y0"), F.lit("Regular").alias("font"), flags.alias("flags"))
