"""Suffix-array deduplication by prefix-free parsing.

1. Over the whole corpus, rolling-hash minima trigger anchors; those of two documents or more show where text can repeat
   at all (see `passages`). Everything else is left out before anything is sorted, which loses no repeated window.
2. The rest is sent, as segments, to buckets by the owner of its windows, so equal windows meet: a small, highly
   repetitive text for each bucket.
3. Each bucket is put in suffix order by prefix-free parsing. A rolling hash of TRIGGER words cuts the text into phrases
   that overlap by as many words. The distinct phrases are the dictionary, whose suffixes are sorted; the text as a
   sequence of phrase ranks is the parse, whose suffixes are sorted as well. A position's order is the rank of what is
   left of its phrase, then the rank of the parse after that phrase.
4. Neighbours in that order that share WORDS words, compared word by word, hold equal windows.
5. Owners of over HOT anchors get into no bucket, see `passages.hot_runs`.

Defined cases: null and empty texts, and those of under WORDS words, have no passage; texts are read whole; of equal
documents the one with the least id keeps its text; rows that repeat a doc_id don't repeat each other; rows without an
id are left out of the report (`remove_repeats` takes different texts under one id as documents of their own, in the order
of a hash) and pass `remove_repeats` unchanged; an empty table gives an empty result; only the named
columns are read, and the others pass `remove_repeats` untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, ids, keyed, partitions, row_keyed, small, written
from .kernels import Powers, chunks, mix, ragged, release, space_table, tidy, window_hashes
from .passages import GRAM, HOT, RUNS, WORDS, anchor_table, by_document, candidate_windows, cut, hot_runs, n_positions, positions_of, repeated, repeated_runs, runs_table, spans, with_positions, words_of

TRIGGER = 4
PERIOD = 8


def dense(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Ranks from 1 on of values, or of pairs of ranks; equal ones share a rank."""
    key = first if second is None else first * (int(second.max(initial=0)) + 1) + second
    return np.unique(key, return_inverse=True)[1].reshape(-1) + 1


def suffix_ranks(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of many strings that lie end to end, by prefix doubling; left[i] symbols remain from i on."""
    rank, k, longest = dense(text), 1, int(left.max(initial=0))
    while k < longest:
        more = np.flatnonzero(left > k)
        after = np.zeros(len(rank), np.int64)
        after[more] = rank[more + k]
        rank = dense(rank, after)
        k *= 2
    return rank


def suffix_order(text: np.ndarray, sizes: np.ndarray, trigger: int = TRIGGER, period: int = PERIOD) -> np.ndarray:
    """The positions of all suffixes of the strings of these sizes, in order, by prefix-free parsing.

    A string's end comes before every symbol; suffixes that are equal up to it stay in order of position.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    end = np.repeat(begin + sizes, sizes)
    cuts = np.zeros(n, bool)
    cuts[begin[sizes > 0]] = True
    power = Powers()
    if n >= trigger:
        rolling = window_hashes(text.astype(np.uint64), trigger, power) % np.uint64(period) == 0
        # The trigger and what follows it are within one string.
        inside = np.arange(n - trigger + 1) + trigger <= end[: n - trigger + 1]
        cuts[: n - trigger + 1] |= rolling & inside
    starts = np.flatnonzero(cuts)
    next_start = np.append(starts[1:], n)
    last = next_start >= end[starts]
    lengths = np.where(last, end[starts], next_start + trigger) - starts
    # Distinct phrases, by a hash of their symbols, length and whether they end the string.
    up_total = np.zeros(n + 1, np.uint64)
    up, down = power(0xD6E8FEB86659FD93, n)
    np.cumsum(mix(text.astype(np.uint64)) * up, out=up_total[1:])
    name = mix((up_total[starts + lengths] - up_total[starts]) * down[starts] + mix((lengths * 2 + last).astype(np.uint64)))
    _, example, phrase = np.unique(name, return_index=True, return_inverse=True)
    # Dictionary: the text of each distinct phrase; one that ends its string ends with symbol 0, before all others.
    size = lengths[example] + last[example]
    at = ragged(starts[example], lengths[example])
    d_begin = np.cumsum(size) - size
    symbols = np.zeros(int(size.sum()), np.int64)
    symbols[ragged(d_begin, lengths[example])] = text[at] + 1
    d_rank = suffix_ranks(symbols, np.repeat(d_begin + size, size) - np.arange(len(symbols)))
    # Parse: phrase ranks, and the order of its suffixes.
    ranks = d_rank[d_begin[phrase]]
    string = np.searchsorted(begin, starts, "right")
    parse_end = np.searchsorted(string, string, "right")
    p_rank = suffix_ranks(ranks, parse_end - np.arange(len(starts)))
    after = np.where(last, 0, np.append(p_rank[1:], 0))
    # A position belongs to the phrase that holds more than its trigger words.
    own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    rest = d_rank[d_begin[phrase[own]] + np.arange(n) - starts[own]]
    return np.lexsort((after[own], rest))


def equal_windows(text: np.ndarray, sizes: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """For each place, a number that it shares with the places at which the same `words` symbols follow."""
    wanted = np.full(len(text), -1, np.int64)
    wanted[places] = np.arange(len(places))
    order = wanted[suffix_order(text, sizes)]
    order = order[order >= 0]
    a, b = places[order[:-1]], places[order[1:]]
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    for k in range(words):
        equal = text[a[live] + k] == text[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(places), np.int64)
    out[order] = group
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc_id): every maximal passage that repeats text of an earlier document."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    found = written(anchor_table(rows, words, gram), "anchors")
    shared = small(written(repeated(found), "repeated"))
    wanted = written(by_document(found.join(shared, "hash").withColumn("hot", F.col("n") > hot)), "positions")
    n_anchors, n_hot = n_positions(wanted)
    buckets = max(partitions(spark), math.ceil(n_anchors * 70 / 750_000))

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
                size = count + words - 1
                keys, at = np.unique(bucket, return_index=True)
                cuts = np.append(at, len(bucket)).astype(np.int32)
                symbols = np.append(0, np.cumsum(size))[cuts].astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v)) for v in (doc_ids[row + text], (start - w.first[text]).astype(np.int32), count.astype(np.int32))]
                content = pa.ListArray.from_arrays(pa.array(symbols), pa.array(w.hashes[ragged(start, size)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *lists, content], names=["bucket", "docs", "starts", "counts", "symbols"])

    def search(table: pa.Table) -> pa.Table:
        doc, start, count, symbols = (np.concatenate([c.flatten().to_numpy() for c in table.column(k).chunks]) for k in ("docs", "starts", "counts", "symbols"))
        count = count.astype(np.int64)
        sizes = count + words - 1
        places = ragged(np.cumsum(sizes) - sizes, count)
        key = equal_windows(dense(symbols), sizes, places, words)
        runs = runs_table(*repeated_runs(key, np.repeat(doc, count), ragged(start.astype(np.int64), count)))
        release()
        return runs

    blocks = with_positions(rows, wanted, "positions").mapInArrow(tidy(send), "bucket int, docs array<bigint>, starts array<int>, counts array<int>, symbols array<bigint>")
    runs = blocks.groupBy("bucket").applyInArrow(search, RUNS)
    return spans(runs.unionByName(hot_runs(rows, wanted, words, gram)) if n_hot else runs, words)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", words: int = WORDS) -> DataFrame:
    """docs, with all columns, without the passages that an earlier document holds; a document of which nothing is left goes.

    length_col, if docs have it, gets the new number of characters. Documents without such a passage stay as they are.
    """
    row, key, starts, ends = (fresh(docs, k) for k in ("span_row", "span_doc", "span_starts", "span_ends"))
    marked = row_keyed(docs, row, id_col, text_col)
    found = repeats(marked, row, text_col, words)
    lists = small(written(found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list("start_word").alias(starts), F.collect_list("end_word").alias(ends)), "spans"))
    same = F.col(row) == F.col(key)
    untouched, touched = marked.join(lists, same, "left_anti").drop(row), marked.join(lists, same).drop(row, key)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            texts = cut(b.column(at), b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist())
            columns = [b.column(i) for i in range(n - 2)]
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                columns[length] = pa.array([len(t) for t in texts], columns[length].type)
            keep = pa.array([bool(t.strip()) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([b.schema.field(i) for i in range(n - 2)])).filter(keep)

    return untouched.union(touched.mapInArrow(tidy(shorten), docs.schema))
