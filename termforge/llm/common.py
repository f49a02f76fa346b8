"""What the operators share on the Spark side: the shared folder, written tables, joins by size, block shuffles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import list_array

BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set, as in tests, and only until Python ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="termforge-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """What this application keeps in the shared folder; `drop_path` on it frees all at once, when results have been written."""
    return f"{shared_dir(spark)}/termforge/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files that a written table is read from."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(name)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
    return total


def small(df: DataFrame, hint: str = "shuffle_hash") -> DataFrame:
    """A written table, marked for broadcast if its files are small, else as the build side of a shuffled hash join."""
    return F.broadcast(df) if table_bytes(df) <= BROADCAST_BYTES else df.hint(hint)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, so no other column can clash; rows without an id can't be reported and are left out."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")


def row_keyed(docs: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """docs with one more column that tells different texts under one id apart, in the order of ids; equal rows share it.

    Where no id has two texts it is the id itself; rows without an id have none.
    """
    own, text = fresh(docs, "key_id"), fresh(docs, "key_text")
    marked = docs.withColumns({own: F.col(f"`{id_col}`").cast("bigint"), text: F.xxhash64(F.col(f"`{text_col}`"))})
    known = marked.where(F.col(own).isNotNull())
    if known.groupBy(own).agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low < high").isEmpty():
        return docs.withColumn(key, F.col(f"`{id_col}`").cast("bigint"))
    numbers = known.select(own, text).distinct().orderBy(own, text).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    table = small(written(docs.sparkSession.createDataFrame(numbers, f"k_id bigint, k_text bigint, `{key}` bigint"), "row_keys"))
    of = table.withColumnsRenamed({"k_id": own + "_of", "k_text": text + "_of"})
    return marked.join(of, (F.col(own) == F.col(own + "_of")) & (F.col(text) == F.col(text + "_of")), "left").select(*(f"`{c}`" for c in docs.columns), f"`{key}`")


def fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Blocks:
    """Collects arrays per bucket, to leave a task as few rows of long lists: the shuffle moves blocks, not rows."""

    def __init__(self, buckets: int, types: dict[str, pa.DataType], flush: int = 1 << 20) -> None:
        self.buckets, self.types, self.flush = buckets, types, flush
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, bucket: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.parts.append((bucket, *values))
            self.size += len(bucket)
        if self.size >= self.flush:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        bucket, *values = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.argsort(bucket, kind="stable")
        keys, at = np.unique(bucket[order], return_index=True)
        offsets = np.append(at, len(order))
        out = [list_array(v[order], offsets).cast(pa.list_(t)) for v, t in zip(values, self.types.values())]
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *out], names=["bucket", *self.types])


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
