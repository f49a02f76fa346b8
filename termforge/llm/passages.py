"""What both finders of repeated passages share.

A window is a run of WORDS consecutive words (runs of other characters than ASCII white space, compared as they are). A
window of a document is *repeated* if a document with a lesser id holds an equal one; a repeated passage is a maximal run
of words that repeated windows cover. Windows never cross documents, and rows that repeat a doc_id are one document, so
they don't repeat each other.

Anchors make the search cheap without missing anything: the least hash among a window's GRAM-word grams is an anchor of
every document that holds the window. A window whose least gram is no anchor of another document is not repeated.

Windows meet by the least gram, their owner. An owner with over HOT anchors would fill a task by itself, as where one passage is in a
third of all documents, so its windows take another way, `hot_runs`: the least document of each window is aggregated before the
exchange, and joined back to windows that stay spread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids, small, written
from .kernels import Powers, anchors, chunks, mix, ragged, sliding, space_table, tidy, utf8, window_hashes, window_valid, word_hashes, word_spans

WORDS = 50
GRAM = 12
HOT = 4096


@dataclass
class Words:
    """The words of a slice of texts: hashes, byte places, first word of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(texts: pa.Array, power: Powers, table: np.ndarray) -> Words:
    data, offsets = utf8(texts)
    starts, ends, first = word_spans(data, offsets, table)
    return Words(word_hashes(data, starts, ends, power), starts, ends, first)


def anchor_table(rows: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(hash, doc_id, pos) of every anchor of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, table = Powers(), space_table()
        for b in batches:
            doc_ids = ids(b)
            for row, part in chunks(b.column("text")):
                w = words_of(part, power, table)
                at, hashes = anchors(w.hashes, w.first, gram, words, power)
                of = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(doc_ids[row + of]), pa.array((at - w.first[of]).astype(np.int32))], names=["hash", "doc_id", "pos"])

    return rows.mapInArrow(tidy(run), "hash bigint, doc_id bigint, pos int")


def candidate_windows(w: Words, positions: list[np.ndarray], words: int, gram: int, power: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts whose least gram is one of the given anchors: (text, first start, starts, owner's hash).

    Equal windows have equal owners, so what is sent by owner meets.
    """
    none = np.zeros(0, np.int64)
    if len(w.hashes) < words:
        return none, none, none, none.astype(np.uint64)
    grams = window_hashes(w.hashes, gram, power)
    owner = sliding(grams, words - gram + 1, np.minimum)
    wanted = [p + f for p, f in zip(positions, w.first[:-1]) if len(p)]
    if not wanted:
        return none, none, none, none.astype(np.uint64)
    wanted = np.concatenate(wanted)
    good = window_valid(w.first, words, len(owner)) & np.isin(owner, grams[wanted[wanted < len(grams)]])
    at = np.flatnonzero(good)
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    text = np.searchsorted(w.first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]]) | (np.diff(text) > 0)
    head = np.flatnonzero(new)
    return text[head], at[head], np.diff(np.append(head, len(at))), owner[at[head]]


def positions_of(batch: pa.RecordBatch, row: int, n: int, name: str = "positions") -> list[np.ndarray]:
    lists = batch.column(name).slice(row, n)
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64) if x.is_valid else np.zeros(0, np.int64) for x in lists]


def repeated_runs(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From windows (any order) with equal keys for equal windows: runs (doc, first start, last start, least doc) of the repeated ones."""
    none = np.zeros(0, np.int64)
    if not len(key):
        return none, none, none, none
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    head = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(doc[order], head)[group]
    late = doc[order] > least
    d, s, f = doc[order][late], start[order][late], least[late]
    if not len(d):
        return none, none, none, none
    by = np.lexsort((s, d))
    d, s, f = d[by], s[by], f[by]
    new = np.ones(len(d), bool)
    new[1:] = (np.diff(d) != 0) | (np.diff(s) > 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(d)) - 1
    return d[head], s[head], s[last], np.minimum.reduceat(f, head)


RUNS = "doc_id bigint, first_start int, last_start int, first_doc_id bigint"


def runs_table(doc: np.ndarray, first: np.ndarray, last: np.ndarray, least: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": doc, "first_start": first.astype(np.int32), "last_start": last.astype(np.int32), "first_doc_id": least})


def spans(runs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): runs of starts as maximal passages; those that overlap or touch are one."""
    order = Window.partitionBy("doc_id").orderBy("first_start", "last_start")
    before = F.max(F.col("last_start") + words).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(before >= F.col("first_start"), 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "island").agg(F.min("first_start").alias("start_word"), (F.max("last_start") + words).alias("end_word"), F.min("first_doc_id").alias("first_doc_id")).drop("island")


def repeated(anchors_: DataFrame) -> DataFrame:
    """(hash, n): hashes that are anchors of two documents or more, and of how many places."""
    return anchors_.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("hash", "n")


def by_document(anchors_: DataFrame) -> DataFrame:
    """(doc_id, positions, hot_positions) of (hash, doc_id, pos, hot)."""
    hot = F.col("hot")
    return anchors_.groupBy("doc_id").agg(F.collect_set(F.when(~hot, F.col("pos"))).alias("positions"), F.collect_set(F.when(hot, F.col("pos"))).alias("hot_positions"))


def n_positions(wanted: DataFrame) -> tuple[int, int]:
    """How many anchors there are of owners that aren't hot, and of those that are."""
    n, n_hot = wanted.agg(F.sum(F.size("positions")), F.sum(F.size("hot_positions"))).first()
    return n or 0, n_hot or 0


def with_positions(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The rows of documents that have such anchors."""
    return rows.join(small(wanted.select("doc_id", name).where(F.size(name) > 0)), "doc_id")


def window_keys(w: Words, places: np.ndarray, words: int, power: Powers) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words of the windows at these places, as two halves."""
    first, second = (window_hashes(w.hashes if k == 0 else mix(w.hashes + np.uint64(0x2545F4914F6CDD1D)), words, power, bool(k))[places].view(np.int64) for k in range(2))
    return first, second


def hot_runs(rows: DataFrame, wanted: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """Runs of the repeated windows of hot owners, compared over all their words by 128 bits; a window in any number of
    documents leaves each task once in the aggregate, and the join back may split it, since it looks up one row."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power, table = Powers(), space_table()
        for b in batches:
            doc_ids = ids(b)
            for row, part in chunks(b.column("text")):
                w = words_of(part, power, table)
                text, start, count, _ = candidate_windows(w, positions_of(b, row, len(part), "hot_positions"), words, gram, power)
                if not len(text):
                    continue
                places = ragged(start, count)
                first, second = window_keys(w, places, words, power)
                own = np.repeat(text, count)
                yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), pa.array(doc_ids[row + own]), pa.array((places - w.first[own]).astype(np.int32))], names=["first", "second", "doc_id", "start"])

    windows = written(with_positions(rows, wanted, "hot_positions").mapInArrow(tidy(send), "first bigint, second bigint, doc_id bigint, start int"), "hot-windows")
    least = windows.groupBy("first", "second").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("high")).where("first_doc_id < high").drop("high")
    late = windows.join(small(written(least, "hot-least")), ["first", "second"]).where("doc_id > first_doc_id")
    order = Window.partitionBy("doc_id").orderBy("start")
    marked = late.withColumn("new", F.when(F.col("start") - F.lag("start").over(order) <= 1, 0).otherwise(1))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "island").agg(F.min("start").alias("first_start"), F.max("start").alias("last_start"), F.min("first_doc_id").alias("first_doc_id")).drop("island")


def cut(texts: pa.Array, starts: list[list[int]], ends: list[list[int]]) -> list[str]:
    """Texts without the words of these spans, and without the white space after them."""
    power, table = Powers(), space_table()
    out: list[str] = []
    for row, part in chunks(texts):
        w = words_of(part, power, table)
        data, offsets = utf8(part)
        for i in range(len(part)):
            lo, hi, base = int(offsets[i]), int(offsets[i + 1]), int(w.first[i])
            kept, at = [], lo
            for s, e in sorted(zip(starts[row + i], ends[row + i])):
                a = int(w.starts[base + s])
                b = int(w.starts[base + e]) if base + e < w.first[i + 1] else hi
                kept.append(data[at:a].tobytes())
                at = b
            kept.append(data[at:hi].tobytes())
            out.append(b"".join(kept).decode().rstrip(" ") if starts[row + i] else part[i].as_py())
    return out


ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM w WHERE len(ws) >= 50),
m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY array_to_string(ws[s + 1 : s + 50], ' ')) AS f FROM p),
r AS (SELECT DISTINCT doc_id, s, f FROM m WHERE f < doc_id),
n AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 >= s THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM n)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + 50 AS INTEGER) AS end_word, min(f) AS first_doc_id FROM i GROUP BY doc_id, island
"""
