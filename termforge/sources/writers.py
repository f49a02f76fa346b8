"""What can be written."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..plans.pipeline import statuses, violations


def write_table(payload: DataFrame, path: str, validate: bool = True) -> None:
    """Output documents as Parquet by profile; with validation, only those that keep to the schema."""
    good = violations(payload).where(F.size("violations") == 0).drop("violations") if validate else payload
    good.write.mode("overwrite").partitionBy("profile").parquet(path)


def address(folder: str) -> str:
    """folder as a URI: of any file system that all executors reach, local paths as they are."""
    return folder if "://" in folder or folder.startswith("file:") else "file://" + folder if folder.startswith("/") else f"file://{Path(folder).resolve()}"


def write_documents(payload: DataFrame, folder: str, validate: bool = True) -> None:
    """A file of indented JSON for each document, named after its source, in a folder that all executors reach.

    Of a source's path the last part gives the name, and what is no letter, digit, dot or hyphen in it becomes an underscore.
    All but the first of equal names get the hash of their id, so none is lost.
    """
    good = violations(payload).where(F.size("violations") == 0).drop("violations") if validate else payload
    last = F.element_at(F.split(F.regexp_replace("source_pdf", "/+$", ""), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(last, r"(?<=.)\.[^.]*$", ""), r"[^\p{L}\p{N}.-]", "_")
    order = Window.partitionBy(stem).orderBy("source_pdf", "source_doc_id")
    name = F.when(F.row_number().over(order) == 1, stem).otherwise(F.concat(stem, F.lit("-"), F.substring(F.md5(F.concat_ws("\n", "source_pdf", "source_doc_id")), 1, 8)))
    named = good.select(name.alias("name"), F.to_json(F.struct(*good.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
    where, at = FileSystem.from_uri(address(folder))
    where.create_dir(at, recursive=True)
    uri = address(folder)

    def save(rows: Iterator[Row]) -> None:
        files, path = FileSystem.from_uri(uri)
        for r in rows:
            with files.open_output_stream(f"{path}/{r['name']}.json") as f:
                f.write((r["json"] + "\n").encode())

    named.foreachPartition(save)


def write_reports(payload: DataFrame, folder: str, failed: DataFrame | None = None) -> dict[str, int]:
    """Lists of the documents without definitions and of the failed ones, each only if there are any; counts by status.

    failed (source_pdf, message) are the files that could not be decoded and so have no output document.
    """
    rows = statuses(payload)
    if failed is not None:
        rows = rows.unionByName(failed.select("source_pdf", F.lit("fail").alias("status"), "message"))
    rows = rows.persist()
    counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
    for status, name in (("no-defs", "NO_DEFINITIONS"), ("fail", "FAILURES")):
        if counts.get(status):
            line = F.concat_ws("\t", "source_pdf", "message")
            rows.where(F.col("status") == status).select(line.alias("value")).sort("value").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/{name}")
    rows.unpersist()
    return counts


def write_snapshot(rows: DataFrame, path: str, sep: str = ",") -> None:
    """One file of separated values with a header: for tables of a report's size."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
