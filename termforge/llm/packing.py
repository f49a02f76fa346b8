"""Packing documents into windows by non-negative least squares.

Lengths are in UTF-8 bytes with one end mark, the tokens of a byte-level model; a column of other lengths may be named. A
document longer than the window is cut into full windows and a remainder, and every full window is a pack of its own.
The remainders are packed:

1. Their histogram, over length classes of window / CLASSES, rounded up, is the only thing that reaches the driver: a few
   numbers however large the table.
2. All combinations of up to three classes that fill a window exactly are enumerated; non-negative least squares gives the
   repeat counts whose histogram is nearest to the real one; they are rounded.
3. What is over is packed greedily, still as a histogram: the largest class left, then again and again the largest that
   fits, as many times at once as the counts allow.
4. The pieces of a class are numbered in the order of id, and the number says which pack a piece is in.

No text is shuffled, and the plan's size depends on CLASSES alone. On the lengths of the test tables the least squares give
as many packs as the greedy step alone would (sf0.1: 2,521 either way, 2,482 being the least that any packing needs).

Defined cases: a null text has no piece; an empty one has length 1 (its end mark); a document of any length is packed
whole; rows that repeat a doc_id are packed each, told apart by `copy`; rows without an id are left out; an empty table
gives an empty result; ties go by id and copy; only the named columns are read.
"""

from __future__ import annotations

import math
import warnings
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 8192
CLASSES = 128
SPLITS = 64
SPLIT_ROWS = 1_000_000


def combinations(classes: int) -> list[tuple[int, ...]]:
    """Up to three classes (1 .. classes) that add up to a whole window."""
    out: list[tuple[int, ...]] = [(classes,)]
    out += [(a, classes - a) for a in range(1, classes // 2 + 1)]
    out += [(a, b, classes - a - b) for a, b in combinations_with_replacement(range(1, classes), 2) if classes - a - b >= b]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for turn in range(rounds + 1):
        if turn == rounds:
            warnings.warn(f"least squares have not converged in {rounds} rounds; what they leave is packed greedily", stacklevel=2)
            break
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance * scale:
            break
        free[j] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            below = free & (s <= tolerance * scale)
            if not below.any():
                x = s
                break
            part = np.min(x[below] / np.maximum(x[below] - s[below], 1e-300))
            x = x + part * (s - x)
            free &= x > tolerance * scale
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(classes in a pack, packs like it) that use every piece of the histogram (index: class) just once."""
    classes = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    packs: list[tuple[tuple[int, ...], int]] = []
    if left[classes]:
        packs.append(((classes,), int(left[classes])))
        left[classes] = 0
    ways = combinations(classes)[1:]
    if ways and left.any():
        a = np.zeros((classes + 1, len(ways)))
        for j, way in enumerate(ways):
            for c in way:
                a[c, j] += 1
        repeats = np.rint(nnls(a, left.astype(float))).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            need = np.bincount(ways[j], minlength=classes + 1)
            used = need > 0
            times = int(min(repeats[j], (left[used] // need[used]).min()))
            if times > 0:
                packs.append((ways[j], times))
                left -= times * need
    while left.any():
        room, way, rest = classes, [], left.copy()
        while room and (fits := np.flatnonzero(rest[: room + 1])).size:
            c = int(fits[-1])
            take = min(room // c, int(rest[c]))
            way += [c] * take
            rest[c] -= take
            room -= c * take
        need = np.bincount(way, minlength=classes + 1)
        used = need > 0
        times = int((left[used] // need[used]).min())
        packs.append((tuple(way), times))
        left -= times * need
    return packs


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first number, count, first pack, pieces of the class in a pack): numbers first .. first + count - 1 go,
    so many at a time, to packs from the first on."""
    out, used, base = [], {}, 0
    for way, times in packs:
        for c in sorted(set(way)):
            each = way.count(c)
            out.append((c, used.get(c, 0), each * times, base, each))
            used[c] = used.get(c, 0) + each * times
        base += times
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, window: int = WINDOW, classes: int = CLASSES) -> DataFrame:
    """(doc_id, copy, piece, start, length, pack_id): every piece of every document, with the window that it is put in.

    length_col names a column of lengths (end mark included) to use in place of the text's bytes; rows whose length is
    null or under 1 have no piece.
    """
    spark = docs.sparkSession
    classes = min(classes, window)
    length = F.col(f"`{length_col}`").cast("bigint") if length_col else F.octet_length(F.col(f"`{text_col}`").cast("string")).cast("bigint") + 1
    sizes = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), length.alias("size")).where("doc_id is not null and size >= 1")
    numbered = sizes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("size")) - 1)
    rows = numbered.select("doc_id", "copy", F.floor(F.col("size") / window).alias("full"), (F.col("size") % window).alias("tail"))
    # Classes are rounded up, so a pack never holds more than its window.
    kind = F.ceil(F.col("tail") * classes / window).cast("int")
    splits = max(SPLITS, math.ceil(docs.count() / SPLIT_ROWS))
    split = F.pmod(F.xxhash64("doc_id", "copy"), F.lit(splits)).cast("int")
    tagged = written(rows.withColumn("class", kind).withColumn("split", split), "lengths")
    tails = tagged.where("tail > 0")
    counts = tails.groupBy("class", "split").agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(classes + 1, np.int64)
    for r in counts:
        histogram[r["class"]] += r["n"]
    packs = plan(histogram)
    places = spark.createDataFrame(slots(packs) or [(0, 0, 0, 0, 1)], "c int, first bigint, many bigint, base bigint, each int")
    # A class is numbered split by split, so that even a class of most pieces is sorted by many tasks.
    before: dict[int, int] = {}
    offsets = []
    for r in sorted(counts, key=lambda r: (r["class"], r["split"])):
        offsets.append((r["class"], r["split"], before.get(r["class"], 0)))
        before[r["class"]] = before.get(r["class"], 0) + r["n"]
    offset = spark.createDataFrame(offsets or [(0, 0, 0)], "class int, split int, offset bigint")
    order = Window.partitionBy("class", "split").orderBy("doc_id", "copy")
    ranked = tails.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(offset), ["class", "split"])
    ranked = ranked.withColumn("number", F.col("rank") + F.col("offset"))
    # Offsets for classes and splits, a few hundred bytes for every million rows, and at most a few thousand places.
    placed = ranked.join(F.broadcast(places), (F.col("class") == F.col("c")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("many")))
    ends = placed.select("doc_id", "copy", F.col("full").cast("int").alias("piece"), (F.col("full") * window).alias("start"), F.col("tail").alias("length"), (F.col("base") + F.floor((F.col("number") - F.col("first")) / F.col("each"))).cast("bigint").alias("pack_id"))
    total = sum(times for _, times in packs)
    whole = tagged.where("full > 0")
    per_split = {r["split"]: r["n"] for r in whole.groupBy("split").agg(F.sum("full").alias("n")).collect()}
    starts, at = [], total
    for s in sorted(per_split):
        starts.append((s, at))
        at += per_split[s]
    base = spark.createDataFrame(starts or [(0, 0)], "split int, base bigint")
    running = Window.partitionBy("split").orderBy("doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    full = whole.withColumn("before", F.coalesce(F.sum("full").over(running), F.lit(0))).join(F.broadcast(base), "split")
    full = full.select("doc_id", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("k"), "before", "base")
    bodies = full.select("doc_id", "copy", F.col("k").cast("int").alias("piece"), (F.col("k") * window).alias("start"), F.lit(window).cast("bigint").alias("length"), (F.col("base") + F.col("before") + F.col("k")).alias("pack_id"))
    return ends.union(bodies)
