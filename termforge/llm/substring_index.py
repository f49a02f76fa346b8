"""Substring deduplication against a log-structured fingerprint index.

The index holds anchors (hash, doc_id, pos; see `passages`) of the text kept so far, as immutable runs: bucketed by hash
and sorted, in the shared folder. Batches come in the order of doc_id. For each batch

1. its anchors are written as a run, and merge-joined with every run of the index (equal buckets, so no exchange);
2. candidates are verified: for the documents that hold a shared anchor, whole windows are read again and compared by a
   128-bit hash of all their words; owners of over HOT anchors take the way of `passages.hot_runs`;
3. anchors whose windows are all repeated are dropped, the rest becomes a run of level 0;
4. as soon as `fan_in` runs share a level they are compacted into one of the next.

Any batch size gives the same result; `batches` is how many the query cuts the id range into. An index outlives its session:
its folder holds the runs, the texts and, after each batch, a new manifest, the last of which `Index.open` goes on from. A
later load (`append`) costs its own text, a merge-join with the runs, and a scan of the earlier texts for those
documents that share an anchor with it. A job that dies between two batches leaves the index as the last manifest has it.

Defined cases: null and empty texts, and those of under WORDS words, have no passage; texts are read whole; of equal
documents the one with the least id is the first; rows that repeat a doc_id don't repeat each other; rows without an id
are left out; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, ids, keyed, new_path, partitions, small, written
from .kernels import Powers, chunks, list_array, mix, ragged, space_table
from .passages import GRAM, HOT, RUNS, WORDS, anchor_table, by_document, candidate_windows, hot_runs, n_positions, positions_of, repeated, repeated_runs, runs_table, spans, window_keys, with_positions, words_of

MANIFEST = "manifest-"
FAN_IN = 2
BATCHES = 4


@dataclass
class Run:
    table: str
    path: str
    level: int


@dataclass
class Index:
    spark: SparkSession
    folder: str
    fan_in: int = FAN_IN
    buckets: int = 0
    runs: list[Run] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    version: int = 0

    def __post_init__(self) -> None:
        self.buckets = self.buckets or partitions(self.spark)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Index:
        """The index as its last manifest in the folder has it; a new one where there is none."""
        where, at = fs.FileSystem.from_uri(folder)
        names = [f.base_name for f in where.get_file_info(fs.FileSelector(at, allow_not_found=True))]
        versions = [int(n.removeprefix(MANIFEST)) for n in names if n.startswith(MANIFEST)]
        if not versions:
            return cls(spark, folder)
        with where.open_input_stream(f"{at}/{MANIFEST}{max(versions)}") as f:
            kept = json.loads(f.read())
        index = cls(spark, folder, kept["fan_in"], kept["buckets"], texts=kept["texts"], version=max(versions))
        for path, level in kept["runs"]:
            index.runs.append(index.register(path, level))
        return index

    def register(self, path: str, level: int) -> Run:
        """A run's files as a table of this session, with its buckets and its order."""
        run = Run(f"termforge_run_{uuid.uuid4().hex}", path, level)
        self.spark.sql(f"CREATE TABLE {run.table} (hash BIGINT, doc_id BIGINT, pos INT) USING parquet CLUSTERED BY (hash) SORTED BY (hash, doc_id, pos) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return run

    def commit(self) -> None:
        """Writes a manifest of what there is now, under a new name."""
        self.version += 1
        where, at = fs.FileSystem.from_uri(self.folder)
        where.create_dir(at)
        with where.open_output_stream(f"{at}/{MANIFEST}{self.version}") as f:
            f.write(json.dumps({"fan_in": self.fan_in, "buckets": self.buckets, "texts": self.texts, "runs": [(r.path, r.level) for r in self.runs]}).encode())

    def write(self, anchors: DataFrame, level: int = 0) -> Run:
        """An immutable run: a bucket by hash to a task, sorted within."""
        run = Run(f"termforge_run_{uuid.uuid4().hex}", f"{self.folder}/run-{uuid.uuid4().hex}", level)
        placed = anchors.repartition(self.buckets, "hash").sortWithinPartitions("hash", "doc_id", "pos")
        placed.write.bucketBy(self.buckets, "hash").sortBy("hash", "doc_id", "pos").option("path", run.path).saveAsTable(run.table)
        return run

    def read(self, run: Run) -> DataFrame:
        return self.spark.table(run.table)

    def drop(self, run: Run) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.table}")
        drop_path(self.spark, run.path)

    def matches(self, hashes: DataFrame) -> list[DataFrame]:
        """The index's anchors whose hash is among these, run by run."""
        return [self.read(r).join(hashes.hint("merge"), "hash", "left_semi") for r in self.runs]

    def add(self, anchors: DataFrame) -> list[Run]:
        """Adds a run and compacts levels that are full; returns the runs that are no longer needed."""
        self.runs.append(self.write(anchors))
        over: list[Run] = []
        while True:
            levels = [r.level for r in self.runs]
            full = next((n for n in sorted(set(levels)) if levels.count(n) >= self.fan_in), None)
            if full is None:
                return over
            old = [r for r in self.runs if r.level == full]
            merged = self.read(old[0])
            for r in old[1:]:
                merged = merged.union(self.read(r))
            new = self.write(merged, full + 1)
            self.runs = [r for r in self.runs if r.level != full] + [new]
            over += old

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the files stay."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r.table}")
        self.runs = []


def verified(rows: DataFrame, wanted: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Runs of repeated windows among the documents of `wanted`, see `passages.by_document`, compared over all their words."""
    n_anchors, n_hot = n_positions(wanted)
    buckets = max(partitions(rows.sparkSession), math.ceil(n_anchors * 20 / 500_000))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, table = Powers(), space_table()
        for b in batches:
            doc_ids = ids(b)
            for row, part in chunks(b.column("text")):
                w = words_of(part, power, table)
                text, start, count, owner = candidate_windows(w, positions_of(b, row, len(part)), words, gram, power)
                if not len(text):
                    continue
                bucket = (mix(owner) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, text, start, count = bucket[order], text[order], start[order], count[order]
                keys, at = np.unique(bucket, return_index=True)
                cuts = np.append(at, len(bucket))
                inner = np.append(0, np.cumsum(count))[cuts]
                places = ragged(start, count)
                first, second = window_keys(w, places, words, power)
                lists = [list_array(v, cuts) for v in (doc_ids[row + text], (start - w.first[text]).astype(np.int32), count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *lists, list_array(first, inner), list_array(second, inner)], names=["bucket", "docs", "starts", "counts", "first", "second"])

    def search(table: pa.Table) -> pa.Table:
        doc, start, count, first, second = (np.concatenate([c.flatten().to_numpy() for c in table.column(k).chunks]) for k in ("docs", "starts", "counts", "first", "second"))
        count = count.astype(np.int64)
        order = np.lexsort((second, first))
        change = np.ones(len(first), bool)
        change[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
        key = np.empty(len(first), np.int64)
        key[order] = np.cumsum(change)
        return runs_table(*repeated_runs(key, np.repeat(doc, count), ragged(start.astype(np.int64), count)))

    kinds = "bucket int, docs array<bigint>, starts array<int>, counts array<int>, first array<bigint>, second array<bigint>"
    runs = with_positions(rows, wanted, "positions").mapInArrow(send, kinds).groupBy("bucket").applyInArrow(search, RUNS)
    return runs.unionByName(hot_runs(rows, wanted, words, gram)) if n_hot else runs


def add_batch(index: Index, rows: DataFrame, batch: DataFrame, words: int = WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Runs of the windows of `batch` that repeat the index or an earlier document of the batch; the rest is indexed.

    rows holds the texts of the batch and of all documents in the index.
    """
    new = index.write(anchor_table(batch, words, gram))
    own = index.read(new)
    hashes = own.select("hash").distinct()
    old = index.matches(hashes)
    known = repeated(own).select("hash")
    for m in old:
        known = known.union(m.select("hash"))
    known = written(known.distinct(), "known")
    held = own.join(small(known), "hash", "left_semi")
    for m in old:
        held = held.union(m)
    held = written(held, "held")
    many = small(written(held.groupBy("hash").count().where(F.col("count") > hot).select("hash", F.lit(True).alias("many")), "hot"))
    wanted = written(by_document(held.join(many, "hash", "left").withColumn("hot", F.coalesce("many", F.lit(False)))), "positions")
    edge = own.agg(F.min("doc_id")).first()[0]
    found = written(verified(rows, wanted, words, gram).where(F.col("doc_id") >= (edge if edge is not None else 0)), "runs")
    # An anchor stays unless every window that holds it is repeated: starts pos - (words - gram) .. pos, as far as there are any.
    lists = small(written(found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(F.struct("first_start", "last_start")).alias("runs")), "run-lists"))
    low = F.greatest(F.col("pos") - (words - gram), F.lit(0))
    covered = F.exists("runs", lambda r: (r.first_start <= low) & (r.last_start >= F.col("pos")))
    kept = own.join(lists, own.doc_id == F.col("d"), "left").where(~F.coalesce(covered, F.lit(False))).select("hash", "doc_id", "pos")
    over = index.add(kept)
    index.commit()
    for run in [new, *over]:
        index.drop(run)
    return found


def append(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id) of a later load, against all that the index holds and against itself; the
    load is indexed. Its ids must be greater than those in the index."""
    spark = index.spark
    path = f"{index.folder}/texts-{uuid.uuid4().hex}"
    keyed(docs, id_col, text_col).write.parquet(path)
    index.texts.append(path)
    batch = spark.read.parquet(path)
    rows = spark.read.schema(batch.schema).parquet(*index.texts)
    return spans(add_batch(index, rows, batch, words, gram, hot), words)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, words: int = WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): every maximal passage that repeats text of an earlier document."""
    rows = keyed(docs, id_col, text_col)
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    found = rows.sparkSession.createDataFrame([], RUNS)
    if low is None:
        return spans(found, words)
    index = Index(rows.sparkSession, new_path(rows.sparkSession, "index"))
    edges = sorted({low + (high + 1 - low) * i // batches for i in range(batches + 1)})
    try:
        for a, b in zip(edges[:-1], edges[1:]):
            upto = rows.where(F.col("doc_id") < b)
            found = found.union(add_batch(index, upto, upto.where(F.col("doc_id") >= a), words, gram, hot))
    finally:
        # Nothing reads this index again.
        index.close()
        drop_path(index.spark, index.folder)
    return spans(found, words)
