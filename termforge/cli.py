"""Command line: extract dictionaries from a file or a folder. Exit 0: done, 1: some documents failed, 2: wrong usage."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.patterns import PROFILES, get_profile
from .operators import layout
from .plans import pipeline
from .sources import pdf, readers, writers
from .sources.shared import clean, exists, stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="termforge", description=__doc__)
    p.add_argument("--version", action="version", version=pipeline.EXTRACTOR_VERSION)
    p.add_argument("-v", "--verbose", action="store_true", help="log what Spark does")
    p.add_argument("--input", help="one PDF or one layout dump (.json)")
    p.add_argument("--input-dir", help="a folder of PDFs, or of layout dumps with --dumps")
    p.add_argument("--output", help="folder for the output of --input")
    p.add_argument("--output-dir", help="folder for the output of --input-dir")
    p.add_argument("--dumps", action="store_true", help="inputs are layout dumps")
    p.add_argument("--profile", default="army", choices=sorted(PROFILES))
    p.add_argument("--gcs-key", help="storage key of --input")
    p.add_argument("--doc-id", help="document id of --input")
    p.add_argument("--manifest", help="JSON map from path to storage key and document id")
    p.add_argument("--workers", type=int, help="tasks that decode PDFs at once (by default, as the files are cut)")
    p.add_argument("--no-validate", action="store_true")
    p.add_argument("--deterministic", action="store_true", help="leave the time of extraction out")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    single, batch = bool(args.input and args.output), bool(args.input_dir and args.output_dir)
    if single == batch or (args.input and args.input_dir) or (batch and (args.gcs_key or args.doc_id)) or (single and args.manifest) or (args.workers is not None and args.workers < 1):
        print("give --input and --output, with --gcs-key and --doc-id if you like, or --input-dir and --output-dir", file=sys.stderr)
        return 2
    source, target = (args.input, args.output) if single else (args.input_dir, args.output_dir)
    spark = spark or SparkSession.builder.appName("termforge").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    if not exists(spark, source):
        print(f"no such file: {source}", file=sys.stderr)
        return 1
    failed: DataFrame | None = None
    if args.dumps or source.endswith(".json"):
        dumps = readers.read_dumps(spark, source).withColumn("path", F.col("doc_id"))
    else:
        files = readers.corpus_files(spark, source)
        dumps = stored(pdf.decode(files.repartition(args.workers) if args.workers else files), "decoded")
        failed = dumps.where("error IS NOT NULL").select(F.col("filename").alias("source_pdf"), F.col("error").alias("message"))
        dumps = dumps.where("error IS NULL").drop("error")
    if args.manifest:
        docs = readers.with_manifest(dumps.select("path", "filename"), readers.read_manifest(spark, args.manifest), source)
    else:
        docs = dumps.select("path", "filename", F.lit(args.gcs_key).cast("string").alias("gcs_key"), F.lit(args.doc_id).cast("string").alias("doc_id"))
    # A dump that says what its document's id is keeps it.
    own = F.col("path") if args.dumps or source.endswith(".json") else F.lit(None).cast("string")
    docs = docs.select(F.col("path").alias("doc_id"), "filename", "gcs_key", F.coalesce("doc_id", own).alias("given_id"))
    payload = stored(pipeline.payloads(docs, layout.pages_of(dumps), layout.spans_of(dumps), get_profile(args.profile), args.deterministic), "payload")
    writers.write_documents(payload, target, not args.no_validate)
    counts = writers.write_reports(payload, target, failed)
    for status, n in sorted(counts.items()):
        print(f"{status}: {n}", file=sys.stderr)
    undecoded = failed is not None and not failed.isEmpty()
    clean(spark)
    return int(bool(undecoded or (counts.get("fail") and not args.no_validate)))


if __name__ == "__main__":
    sys.exit(main())
