"""Language-model scoring by n-grams of any length, from sharded suffix arrays of the corpus.

Each task cuts its part of the corpus into shards of about SHARD_BYTES and sorts the word suffixes of each; a suffix ends
with its document. The scored texts are searched in every shard: for every place of a text the interval of suffixes that
begin with the words from there is found by binary search, and narrowed word by word for as long as it isn't empty, so
there is no greatest n (sorting goes as deep as the longest scored text, beyond which no match can reach). Counts are
summed over the shards. A word's probability starts from the floor 1 / (N + 1) of a corpus of N words and goes through the
contexts from none up to the longest that the corpus holds before some word:

    p_n = (count(context_n, word) + ALPHA * p_{n-1}) / (count(context_n, any word) + ALPHA)

What a shard hands on are counts of the texts' own word sequences. The texts reach the tasks in blocks of at most
BLOCK_BYTES; more of them take more passes over the corpus, not more memory.

Defined cases: a null text has null scores; a text without a word has 0 words, log2 probability 0 and null averages;
repeated rows get equal rows; null and empty corpus texts add nothing; with an empty corpus every word has the floor's
probability, which is 1; an empty table of texts gives an empty result; words are runs of other characters than ASCII
white space, compared as they are; texts are read whole; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .kernels import Powers, chunks, space_table
from .passages import words_of
from .suffix_dedup import dense

ALPHA = 1.0
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
COUNTS = "item int, start int, length int, found bigint, followed bigint"


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next `depth` symbols at least; symbol 0 ends a document and is before all others."""
    rank, k = dense(text), 1
    ends = np.flatnonzero(text == 0)
    to_end = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
    while k < depth:
        after = np.zeros(len(text), np.int64)
        more = np.flatnonzero(to_end >= k)
        if not len(more):
            break
        after[more] = rank[more + k]
        new = dense(rank, after)
        k *= 2
        if new.max(initial=0) == len(text):
            rank = new
            break
        rank = new
    return np.argsort(rank, kind="stable")


def bound(text: np.ndarray, sa: np.ndarray, low: np.ndarray, high: np.ndarray, offset: int, word: np.ndarray, right: bool) -> np.ndarray:
    """Binary search, for all queries at once, among the suffixes low .. high - 1 by their symbol at an offset."""
    low, high = low.copy(), high.copy()
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live]) // 2
        symbol = text[np.minimum(sa[mid] + offset, len(text) - 1)]
        less = symbol <= word[live] if right else symbol < word[live]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]


def count_matches(text: np.ndarray, sa: np.ndarray, queries: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, query places, occurrences, occurrences before another word) for each length that still occurs."""
    places = np.flatnonzero(queries > 0)
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(text))
    length = 0
    while len(places):
        word = queries[places + length]
        low, high = bound(text, sa, low, high, length, word, False), bound(text, sa, low, high, length, word, True)
        length += 1
        some = high > low
        places, low, high = places[some], low[some], high[some]
        if not len(places):
            return
        first = bound(text, sa, low, high, length, np.zeros(len(places), np.int64), True)
        yield length, places, high - low, high - first
        go = (left[places] > length) & (high > first)
        places, low, high = places[go], first[go], high[go]
        known = queries[places + length] > 0
        places, low, high = places[known], low[known], high[known]


def corpus_counts(rows: DataFrame, texts: list[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Counts over the corpus (text) of all word sequences of the texts; item -1 has the number of words."""
    w = words_of(pa.array(texts, pa.string()), Powers(), space_table())
    item = np.repeat(np.arange(len(texts)), np.diff(w.first))
    start = np.arange(len(item)) - w.first[item]
    left = w.first[item + 1] - np.arange(len(item)) if len(item) else np.zeros(0, np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((w.hashes, item.astype(np.int32), start.astype(np.int32), left))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, item, start, left = shared.value
        power, table = Powers(), space_table()
        depth = int(left.max(initial=1)) + 1
        for b in batches:
            for _, part in chunks(b.column("text"), shard_bytes):
                w = words_of(part, power, table)
                n = len(w.hashes)
                if not n:
                    continue
                total = [np.array([x]) for x in (-1, 0, 0, n, n)]
                words, rank = np.unique(w.hashes, return_inverse=True)
                # Each text's words, then 0.
                text = np.zeros(n + len(w.first) - 1, np.int64)
                text[np.arange(n) + np.searchsorted(w.first[1:], np.arange(n), "right")] = rank.reshape(-1) + 1
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                known = np.where(words[at] == hashes, at + 1, 0)
                parts = [total]
                for length, places, found, followed in count_matches(text, suffix_array(text, depth), known, left):
                    parts.append([item[places], start[places], np.full(len(places), length), found, followed])
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int32, np.int32, np.int32, np.int64, np.int64))], names=["item", "start", "length", "found", "followed"])

    return rows.mapInArrow(run, COUNTS).groupBy("item", "start", "length").agg(F.sum("found").alias("found"), F.sum("followed").alias("followed"))


def score_text(n_words: int, counts: dict[tuple[int, int], tuple[int, int]], total: int, alpha: float) -> tuple[float, float]:
    """(log2 probability, mean number of words of the longest context) from (start, length) -> (found, followed)."""
    log, contexts = 0.0, 0
    for i in range(n_words):
        p = (counts.get((i, 1), (0, 0))[0] + alpha / (total + 1)) / (total + alpha)
        n = 1
        while n <= i and (context := counts.get((i - n, n))) and context[1]:
            p = (counts.get((i - n, n + 1), (0, 0))[0] + alpha * p) / (context[1] + alpha)
            n += 1
        log += math.log2(p)
        contexts += n - 1
    return log, contexts / n_words if n_words else 0.0


def _scorer(total: int, alpha: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def one(key: pa.Table, own: pa.Table) -> pa.Table:
        if not key.num_rows:
            raise ValueError("counts without their text")
        text = key.column("text")[0].as_py()
        w = words_of(pa.array([text], pa.string()), Powers(), space_table())
        found = {(s, n): (c, f) for s, n, c, f in zip(*(own.column(c).to_pylist() for c in ("start", "length", "found", "followed")))}
        log, context = score_text(len(w.hashes), found, total, alpha)
        return pa.table({"item_text": pa.array([text], pa.string()), "n_words": pa.array([len(w.hashes)], pa.int32()), "log2_probability": [log], "mean_context": [context]})

    return one


def score(texts: DataFrame, corpus: DataFrame, id_col: str = "item_id", text_col: str = "text", corpus_col: str = "text", alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, n_words, log2_probability, perplexity, mean_context) of every row of texts."""
    spark = texts.sparkSession
    rows = texts.select(F.col(f"`{id_col}`").cast("bigint").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    source = corpus.select(F.col(f"`{corpus_col}`").cast("string").alias("text")).where("text is not null")
    distinct = written(rows.select("text").where("text is not null").distinct(), "texts")
    size = distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    schema = "item_text string, n_words int, log2_probability double, mean_context double"
    scored = spark.createDataFrame([], schema)
    for k in range(blocks):
        block = sorted(r["text"] for r in distinct.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect())
        if not block:
            continue
        counts = written(corpus_counts(source, block, shard_bytes), "counts")
        total = int(counts.where("item = -1").agg(F.sum("found")).first()[0] or 0)
        keys = spark.createDataFrame([(i, t) for i, t in enumerate(block)], "item int, text string")

        scored = scored.union(keys.groupBy("item").cogroup(counts.where("item >= 0").groupBy("item")).applyInArrow(_scorer(total, alpha), schema))
    joined = rows.join(scored, rows.text == F.col("item_text"), "left")
    some = F.col("n_words") > 0
    return joined.select(
        "item_id",
        "n_words",
        F.round("log2_probability", 6).alias("log2_probability"),
        F.when(some, F.round(F.pow(F.lit(2.0), -F.col("log2_probability") / F.col("n_words")), 4)).alias("perplexity"),
        F.when(some, F.round("mean_context", 6)).alias("mean_context"),
    )
