"""Snapshots, label sets, scorecards and cohorts: how extraction results are judged and compared."""

from __future__ import annotations

import _hashlib
import ctypes
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.classify import classify
from ..sources.shared import stored

# Least precision, recall and definition overlap, by kind of publication and source.
THRESHOLDS = [("AR", "glossary", 0.95, 0.85, 0.85), ("PAM", "glossary", 0.90, 0.80, 0.80), *((k, "glossary", 0.85, 0.75, 0.75) for k in ("ADP", "ATP", "FM", "TC", "TM")), ("*", "inline", 0.75, 0.50, 0.65)]
THRESHOLD_SCHEMA = "doc_type string, source_type string, min_precision double, min_recall double, min_jaccard double"
TIER1_RECALL = 0.95
# Of the library's SHA256_CTX, and of what one task reads for a hash.
SHA256_STATE, PIECE_BYTES = 112, 64 << 20


def prefix_matches(rows: DataFrame, text_col: str, prefixes: DataFrame, prefix_col: str) -> DataFrame:
    """rows with each of the prefixes (and its other columns) that a text begins with; those that begin with none are left out.

    Beginnings of as many lengths as the prefixes have are compared for equality, so no row meets all prefixes; the
    lengths are the one thing that is collected, and there are no more of them than the longest prefix has characters.
    """
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix_col)).where(F.col(prefix_col).isNotNull()).distinct().collect())
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(text_col))
    begun = rows.withColumn("beginning", F.explode(F.transform(cuts, lambda n: F.substring(text_col, F.lit(1), n))))
    return begun.join(prefixes, F.col("beginning") == F.col(prefix_col)).drop("beginning")


def verdicts(entries: DataFrame) -> DataFrame:
    """(pdf, source_type, term, verdict) of entries (pdf, source_type, term, definition)."""
    return entries.select("pdf", "source_type", "term", classify(F.col("term"), F.col("definition")).alias("verdict"))


def candidate_entries(candidates: DataFrame) -> DataFrame:
    """(pdf, source_type, term, definition) of all entries of output documents."""
    one = candidates.select(F.col("source_pdf").alias("pdf"), F.explode("entries").alias("e"))
    return one.select("pdf", "e.source_type", "e.term", "e.definition")


def hash_of(state: bytes) -> str:
    if not state:
        return hashlib.sha256().hexdigest()
    ctx, out = ctypes.create_string_buffer(state, SHA256_STATE), ctypes.create_string_buffer(32)
    ctypes.CDLL(_hashlib.__file__).SHA256_Final(out, ctx)
    return out.raw.hex()


def corpus_hash(files: DataFrame, name_col: str, content_col: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(corpus_hash): one SHA-256 over all names and contents in the order of names, as 'sha256:...'.

    A hash of a sequence is taken in sequence: all tasks sort the names into files of about piece_bytes, then one task after
    another reads one file and hands the state of the hash on. Only rows of one name always share a file.
    """
    spark = files.sparkSession
    rows = files.select(F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content")).where("name IS NOT NULL AND content IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("name") + F.octet_length("content"))).first()[0] or 0
    pieces = stored(rows.repartitionByRange(1 + size // piece_bytes, "name").sortWithinPartitions("name", "content"), "pieces")

    def hashed_on(state: bytes, where: fs.FileSystem, path: str) -> bytes:
        """The state of a SHA-256, b"" at first, after the names and contents of a file.

        hashlib does not give its state away, so the functions of the library that it is linked to are called.
        """
        lib, ctx = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state, SHA256_STATE)
        if not state:
            lib.SHA256_Init(ctx)
        with where.open_input_file(path) as file:
            for b in pq.ParquetFile(file).iter_batches(1000):
                for row in zip(b.column("name"), b.column("content")):
                    for data in (row[0].as_py().encode(), row[1].as_py()):
                        lib.SHA256_Update(ctx, data, ctypes.c_size_t(len(data)))
        return ctx.raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pydict({"state": pa.array([hashed_on(r["state"], *fs.FileSystem.from_uri(r["path"]))], pa.binary())})

    state = b""
    for path in sorted(pieces.inputFiles(), key=lambda p: p.rpartition("/")[2]):
        state = bytes(spark.createDataFrame([(path, bytearray(state))], "path string, state binary").coalesce(1).mapInArrow(run, "state binary").first()[0])
    return spark.createDataFrame([(f"sha256:{hash_of(state)}",)], "corpus_hash string")


def verdict_counts(rows: DataFrame) -> DataFrame:
    """(source_type, g, b)."""
    return rows.groupBy("source_type").agg(F.count_if(F.col("verdict") == "g").alias("g"), F.count_if(F.col("verdict") == "b").alias("b"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pdf, source_type, term, change) between two verdict snapshots: added, removed, b->g, g->b or same."""
    key = ["pdf", "source_type", "term"]
    a = old.groupBy(*key).agg(F.min("verdict").alias("before"))
    b = new.groupBy(*key).agg(F.min("verdict").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise(F.concat("before", F.lit("->"), "after"))
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def term_sets(entries: DataFrame, by: str = "pdf") -> DataFrame:
    return entries.where("term_normalized <> ''").groupBy(by).agg(F.array_sort(F.collect_set("term_normalized")).alias("term_set"))


def missing_labels(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """Labels (pdf, term_normalized, source_type, ..) that no entry meets."""
    return labels.join(entries, ["pdf", "term_normalized", "source_type"], "left_anti")


def met_labels(labels: DataFrame, entries: DataFrame) -> DataFrame:
    return labels.join(entries, ["pdf", "term_normalized", "source_type"], "left_semi")


def scorecard(labels: DataFrame, entries: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Recall, precision and definition overlap by kind of publication and source.

    labels (pdf, doc_type, kind, term_normalized, definition, source_type); kind is labels or negative_labels. Inline
    results of all kinds count together. Precision is taken over documents with negative labels only, and null without.
    """
    spark: SparkSession = labels.sparkSession
    thresholds = thresholds if thresholds is not None else spark.createDataFrame(THRESHOLDS, THRESHOLD_SCHEMA)
    key = ["pdf", "source_type"]
    # The entry that was met last stands for a term.
    found = entries.groupBy(*key, "term_normalized").agg(F.max_by("definition", F.col("ord") if "ord" in entries.columns else F.lit(0)).alias("found"), F.lit(True).alias("hit"))
    positive, negative = labels.where("kind = 'labels'"), labels.where("kind = 'negative_labels'")
    hit = F.coalesce("hit", F.lit(False))
    own = positive.join(found, [*key, "term_normalized"], "left").groupBy(*key, "doc_type").agg(
        F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fn"), F.sum(F.when(hit, T.token_jaccard(F.col("found"), F.col("definition")))).alias("overlap")
    )
    bad = negative.select(*key, "term_normalized").distinct().join(found, [*key, "term_normalized"], "left").groupBy(*key).agg(F.count_if(hit).alias("fp"), F.lit(True).alias("judged"))
    group = F.when(F.col("source_type") == "inline", "*").otherwise(F.col("doc_type"))
    judged = F.coalesce("judged", F.lit(False))
    total = own.join(bad, key, "left").groupBy(group.alias("doc_type"), "source_type").agg(
        F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.coalesce(F.sum("overlap"), F.lit(0.0)).alias("overlap"),
        F.sum(F.coalesce("fp", F.lit(0))).alias("fp_explicit"), F.sum(F.when(judged, F.col("tp")).otherwise(0)).alias("tp_in_negative_docs"), F.max(judged).alias("had_negatives"),
    )
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    overlap = F.when(F.col("tp") > 0, F.col("overlap") / F.col("tp")).otherwise(F.lit(0.0))
    whole = F.col("tp_in_negative_docs") + F.col("fp_explicit")
    precision = F.when(F.col("had_negatives"), F.when(whole > 0, F.col("tp_in_negative_docs") / whole).otherwise(F.lit(1.0)))
    passed = (recall >= F.col("min_recall")) & (overlap >= F.col("min_jaccard")) & F.coalesce(precision >= F.col("min_precision"), F.lit(True))
    return total.join(thresholds, ["doc_type", "source_type"]).select(
        "doc_type", "source_type", "tp", "fn", "fp_explicit", "tp_in_negative_docs", "had_negatives",
        F.round(recall, 3).alias("recall"), F.round(precision, 3).alias("precision"), F.round(overlap, 3).alias("def_jaccard"), passed.alias("passed"),
    )


def tier_scorecard(labels: DataFrame, entries: DataFrame, fallback: DataFrame) -> DataFrame:
    """(tier, positive_total, positive_present, positive_recall, negative_violations, passed) for confirmed and automatic labels.

    Documents (pdf) of fallback are judged by their confirmed positive terms alone.
    """
    key = ["pdf", "term_normalized", "source_type"]
    hit = entries.select(*key).distinct().withColumn("hit", F.lit(True))
    kinds = {"tier1_positive_terms": (1, True), "negative_labels": (1, False), "auto_positive_labels": (2, True), "auto_negative_labels": (2, False)}
    tier, good = (F.coalesce(*(F.when(F.col("kind") == k, F.lit(v[i])) for k, v in kinds.items())) for i in range(2))
    marked = labels.where(F.col("kind").isin(*kinds)).select(*key, tier.alias("tier"), good.alias("good")).join(fallback.select("pdf").distinct().withColumn("fell", F.lit(True)), "pdf", "left")
    used = marked.where(F.col("fell").isNull() | ((F.col("tier") == 1) & F.col("good"))).join(hit, key, "left")
    met = F.coalesce("hit", F.lit(False))
    g = used.groupBy("tier").agg(F.count_if("good").alias("positive_total"), F.count_if(F.col("good") & met).alias("positive_present"), F.count_if(~F.col("good") & met).alias("negative_violations"))
    recall = F.when(F.col("positive_total") > 0, F.col("positive_present") / F.col("positive_total")).otherwise(F.lit(1.0))
    passed = F.when(F.col("tier") == 1, (F.col("negative_violations") == 0) & (recall >= TIER1_RECALL))
    return g.select("tier", "positive_total", "positive_present", F.round(recall, 3).alias("positive_recall"), "negative_violations", passed.alias("passed"))


def stratification(docs: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_type, want, have, enough) of expected (doc_type, want) against docs (doc_type)."""
    have = docs.groupBy("doc_type").agg(F.count("*").alias("have"))
    n = F.coalesce("have", F.lit(0))
    return expected.join(have, "doc_type", "left").select("doc_type", "want", n.alias("have"), (n >= F.col("want")).alias("enough"))


def golden_diff(actual: DataFrame, golden: DataFrame, accepted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of golden whose actual row differs in a column, or is missing, and that aren't accepted deviations."""
    same = actual.select(F.col(key).alias("k"), *(F.col(c).alias(f"actual_{c}") for c in columns))
    joined = golden.join(accepted.select(key).distinct(), key, "left_anti").join(same, F.col(key) == F.col("k"), "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"actual_{c}")), F.lit(c)) for c in columns]
    changed = F.when(F.col("k").isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(*differs)))
    return joined.select(key, changed.alias("changed")).where(F.size("changed") > 0)


def section_distribution(payload: DataFrame, baseline: DataFrame) -> DataFrame:
    """(pdf, section_structure, fired, entry_count, baseline_count, delta); baseline (source_pdf, n) is met by the stem's prefix."""
    stems = payload.withColumn("stem", F.regexp_replace("pdf", r"\.[^.]*$", ""))
    met = prefix_matches(baseline, "source_pdf", stems.select("stem").distinct(), "stem").groupBy("stem").agg(F.min_by("n", "source_pdf").alias("baseline_count"))
    g = stems.join(met, "stem", "left").select("pdf", "section_structure", "fired", "entry_count", "baseline_count")
    return g.withColumn("delta", F.col("entry_count") - F.col("baseline_count"))


def section_groups(rows: DataFrame) -> DataFrame:
    """rows (document_id, section_structure, narrowing_fired) with the group that a wider acronym band helps, and how far.

    A null narrowing_fired is a document without a trace.
    """
    fired = F.col("narrowing_fired")
    group: Column = F.when(fired.isNull(), "missing_trace").when(fired, "B_narrowed_partial_benefit").otherwise("A_full_range_direct_target")
    return rows.withColumn("target_group", group).withColumn("benefit", F.when(fired, "partial").when(~fired, "full"))


COHORT = """
SELECT q.document_id, d.canonical_id, d.gcs_key
FROM {queue} q JOIN {documents} d ON d.id = q.document_id
WHERE q.status = 'SUCCEEDED' AND q.extractor_version = :version AND q.entry_count = 0
  AND d.extracted_text_status = 'HAS_TEXT' AND d.extracted_text ILIKE '%glossary%'
  AND length(d.extracted_text) > :least AND d.page_count >= :pages
"""


def failing_cohort(queue: DataFrame, documents: DataFrame, version: str, least: int = 100_000, pages: int = 30) -> DataFrame:
    """Documents that were extracted without an entry although their text speaks of a glossary."""
    return queue.sparkSession.sql(COHORT, args={"version": version, "least": least, "pages": pages}, queue=queue, documents=documents)


def requeued(queue: DataFrame, documents: DataFrame, version: str, least: int = 100_000) -> DataFrame:
    """queue with the rows of such documents back to PENDING, their version, failure and counts cleared."""
    text = documents.where((F.col("extracted_text_status") == "HAS_TEXT") & F.col("extracted_text").ilike("%glossary%") & (F.length("extracted_text") > least))
    again = text.select(F.col("id").alias("document_id")).distinct().withColumn("again", F.lit(True))
    hit = F.coalesce("again", F.lit(False)) & (F.col("status") == "SUCCEEDED") & (F.col("extractor_version") == version) & (F.col("entry_count") == 0)
    joined = queue.join(again, "document_id", "left")
    changed = {"status": F.lit("PENDING"), "extractor_version": F.lit(None), "attempts": F.lit(0), "failure_reason": F.lit(None), "error_snippet": F.lit(None), "last_attempt_at": F.lit(None), "next_attempt_at": F.lit(None)}
    return joined.select(*(F.when(hit, changed[c].cast(queue.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in queue.columns))


def build_labels(entries: DataFrame, overrides: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(pdf, kind, term, source_type): labels from the classifier's verdicts and a reader's overrides.

    overrides (prefix, term, action: to_bad, to_good or exclude) and reviewed (prefix) are met by the beginning of the name.
    """
    base = verdicts(entries)
    names = base.select("pdf").distinct()
    known = prefix_matches(names, "pdf", reviewed.select(F.col("prefix").alias("rp")).distinct(), "rp").select("pdf", F.lit(True).alias("known")).distinct()
    acts = prefix_matches(names, "pdf", overrides.select("prefix").distinct(), "prefix").join(overrides.distinct(), "prefix").groupBy("pdf", "term").agg(F.collect_set("action").alias("actions"))
    marked = base.distinct().join(known, "pdf", "left").withColumn("reviewed", F.coalesce("known", F.lit(False))).join(acts, ["pdf", "term"], "left")
    act = lambda a: F.col("reviewed") & F.array_contains("actions", a)
    kind = (
        F.when(act("exclude"), None)
        .when(act("to_bad"), "negative_labels")
        .when(act("to_good"), "tier1_positive_terms")
        .when(F.col("reviewed") & (F.col("verdict") == "b"), "negative_labels")
        .when(F.col("reviewed"), "tier1_positive_terms")
        .when(F.col("verdict") == "g", "auto_positive_labels")
        .otherwise("auto_negative_labels")
    )
    return marked.select("pdf", kind.alias("kind"), "term", "source_type").where("kind IS NOT NULL")
