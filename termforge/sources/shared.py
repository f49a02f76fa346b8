"""Intermediate tables in the folder that all executors share, so that no plan is computed twice and no lineage is lost with an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set, as in tests, and only until Python ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="termforge-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """What this application keeps in the shared folder."""
    return f"{folder(spark)}/termforge/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any of Spark's file systems exists."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clean(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; what is read from them must have been written by then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
