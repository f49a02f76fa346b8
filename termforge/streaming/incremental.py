"""An extension: new layout dumps are extracted as they arrive. A document that was extracted before, in the same version and with the same text, is not extracted again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.patterns import Profile
from ..operators import layout, ranges
from ..operators.layout import DUMP_SCHEMA
from ..plans import pipeline
from ..sources.shared import exists


def dumps_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DUMP_SCHEMA).json(path)


def extract_new(dumps: DataFrame, done: DataFrame | None, profile: Profile) -> DataFrame:
    """Payloads of the dumps whose (text hash, version) is not among those of done; of equal dumps the first by id."""
    layers = ranges.text_layers(layout.pages_of(dumps))
    key = F.coalesce("text_sha256", F.col("doc_id"))
    first = layers.select("doc_id", key.alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    if done is not None:
        old = done.where(F.col("extractor_version") == pipeline.EXTRACTOR_VERSION).select(F.coalesce("text_sha256", F.col("source_doc_id")).alias("k"))
        first = first.join(old, "k", "left_anti")
    new = dumps.join(first, "doc_id", "left_semi")
    docs = new.select("doc_id", "filename", F.lit(None).cast("string").alias("gcs_key"))
    return pipeline.payloads(docs, layout.pages_of(new), layout.spans_of(new), profile)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, profile: Profile) -> StreamingQuery:
    """Each micro-batch appends to the target under its own number, so a batch that is run again replaces itself."""

    def batch(dumps: DataFrame, number: int) -> None:
        own = dumps.sparkSession
        # Of what is there three columns are read, and none of this batch's own partition.
        done = own.read.parquet(target).where(F.col("batch") != number) if exists(own, target) else None
        extract_new(dumps, done, profile).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return dumps_stream(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
