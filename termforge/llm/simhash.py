"""SimHash near-duplicates: 128-bit fingerprints, and all close pairs by the May-Ozerov recursion.

Fingerprint. Features are the pairs of neighbouring words (lower case, split at all but letters and digits; the word
itself where there is just one), weighted by the square root of their count in the text. Bit i is the sign of the
weighted sum of the features' bits i.

Search. A repetition draws a random strip of coordinates, and random centres on it. A fingerprint goes to every list whose centre differs from it, on the strip, in few enough coordinates: the partial weight of (fingerprint XOR centre) is
at most a bound. Close fingerprints have correlated partial weights and so stay together more often than others. Each list is
recursed into in the same way, with strips and centres of its own, until lists are small (SMALL on average); these are
compared by brute force. How many levels there are, and each one's bound, centres and repetitions, follows from the number
of fingerprints, the distance and the target recall, by the least cost.

Fingerprints aren't spread evenly, so lists are counted first. One of over HOT gets a pivot: of PIVOTS of its members the one
that has most others within the distance. Those are all connected through it and needn't be compared with one another,
only with the rest of the list; they are cut by a hash into parts that each meet the rest, and a rest that is large is cut
into parts as well, every two of which meet. So no brute force is over a list of more than HOT, a dense cluster costs its
members and not its pairs, and nothing is left out. A list hands on the edges of a spanning forest of the close pairs that it
holds, not the pairs.

DISTANCE is the least even one at which 98 % of generated copies with 5 % of their words edited are found (98.7 %; 74 % of
those with 10 % edited); on a second set of 1,500 it finds 98.5 % (2 % edited: 99.9 %), with no unrelated pair of 1.1 million.

Defined cases: a null text or one without a word has no fingerprint and is in no group; texts of any length are read
whole; equal fingerprints are one node, however many documents have it; rows that repeat a doc_id are one document with
the least of its fingerprints; rows without an id are left out; an empty table gives an empty result; only the id and
text columns are read. Ties: the least doc_id of a group is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Blocks, ids, keyed, partitions, small, written
from .components import components, joined
from .kernels import Powers, alnum_table, chunks, mix, tidy, utf8, window_hashes, word_hashes, word_spans

BITS = 128
DISTANCE = 26
RECALL = 0.97
STRIP = 32
SMALL = 16384
HOT = 2 * SMALL
PIVOTS = 8
SEED = 20240613
FEATURE = np.uint64(40)
FEATURE_MASK = np.uint64((1 << 40) - 1)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, has words) for each text."""
    high, low, has = (np.zeros(len(texts), t) for t in (np.uint64, np.uint64, bool))
    power, table = Powers(), alnum_table()
    for row, part in chunks(texts):
        data, offsets = utf8(pc.utf8_lower(part))
        starts, ends, first = word_spans(data, offsets, table)
        words, counts = word_hashes(data, starts, ends, power), np.diff(first)
        if not len(words):
            continue
        doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        pair = words.copy()
        if len(words) > 1:
            inside = doc[1:] == doc[:-1]
            pair[:-1][inside] = window_hashes(words, 2, power)[inside]
        last = np.zeros(len(words), bool)
        last[first[1:][counts > 0] - 1] = True
        keep = ~last | (np.repeat(counts, counts) == 1)
        # As many bits for the row whatever the slice, so that a text's features don't depend on its neighbours.
        key, times = np.unique((doc[keep] << FEATURE) | (pair[keep] & FEATURE_MASK), return_counts=True)
        feature = mix(key & FEATURE_MASK)
        weight = np.sqrt(times).astype(np.float32)
        cut = np.searchsorted(key >> FEATURE, np.arange(len(counts) + 1, dtype=np.uint64))
        sums = np.zeros((len(counts), BITS), np.float32)
        for half in range(2):
            bits = np.unpackbits((feature if half == 0 else mix(feature + np.uint64(0x9E3779B97F4A7C15))).view(np.uint8).reshape(-1, 8), axis=1)
            for d in np.flatnonzero(np.diff(cut)):
                w = weight[cut[d] : cut[d + 1]]
                sums[d, half * 64 : half * 64 + 64] = 2 * (w @ bits[cut[d] : cut[d + 1]]) - w.sum()
        packed = np.packbits(sums > 0, axis=1).view(np.uint64)
        high[row : row + len(part)], low[row : row + len(part)], has[row : row + len(part)] = packed[:, 0], packed[:, 1], counts > 0
    return high, low, has


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, high, low) of every document with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            high, low, has = fingerprints(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (ids(b), high.view(np.int64), low.view(np.int64))], names=["doc_id", "high", "low"])

    return keyed(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id bigint, high bigint, low bigint")


def _joint(strip: int, bound: int, apart: int) -> float:
    """Chance that two vectors that differ in `apart` of `strip` coordinates both lie within `bound` of a random centre."""
    total = 0
    for i in range(strip - apart + 1):
        for j in range(apart + 1):
            if i + j <= bound and i + apart - j <= bound:
                total += math.comb(strip - apart, i) * math.comb(apart, j)
    return total / 2**strip


@dataclass(frozen=True)
class Level:
    bound: int
    centres: int
    repetitions: int
    share: float  # of the fingerprints, near each centre


@lru_cache(maxsize=65536)
def plan(n: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[Level, ...]:
    """The cheapest recursion, into lists of at most SMALL on average, that finds pairs at the full distance with this chance
    (nearer pairs do better); none for so few.

    Only the first level is repeated. The strips' shares of the differing coordinates are taken as even, and the
    repetitions that this gives are increased by a fifth for their spread.
    """
    if n <= SMALL:
        return ()
    apart = round(distance * STRIP / BITS + 0.49)
    best: tuple[float, tuple[Level, ...]] = math.inf, ()
    for depth in range(1, BITS // STRIP + 1):
        for bound in range(4, 14):
            one, two = _joint(STRIP, bound, 0), _joint(STRIP, bound, apart)
            length = n * one**depth
            if not two or length > SMALL:
                continue
            centres = max(1, round(1 / one))
            found = (1 - (1 - two) ** centres) ** depth
            repetitions = math.ceil(1.2 * math.log(1 - recall) / math.log1p(-min(found, 0.999)))
            # Nanoseconds: an entry of a list that is sent (its bytes are dearer than its time), a comparison, a centre that is tried.
            cost = repetitions * ((one * centres) ** depth * (12000 + 5 * length / 2) + 4 * centres * depth)
            if cost < best[0]:
                best = cost, (Level(bound, centres, repetitions, one), *[Level(bound, centres, 1, one)] * (depth - 1))
    return best[1]


def _below(number: int, k: int) -> int:
    """The number of the k-th list below a list."""
    return int(mix(np.array([(number * 1_000_003 + k + 1) & (1 << 64) - 1], np.uint64))[0] >> np.uint64(2))


@dataclass
class Hot:
    """A list that is over the bound: its pivot, and the parts that those near it and the rest are cut into."""

    high: np.uint64
    low: np.uint64
    near_parts: int
    rest_parts: int


class Lists:
    """Which fingerprints are in which lists; strips and centres are made from the list's number wherever they are needed."""

    def __init__(self, how: tuple[Level, ...], distance: int, seed: int = SEED) -> None:
        self.how, self.distance, self.seed = how, distance, seed
        self.hot: dict[int, Hot] = {}

    def _descend(self, bits: np.ndarray, rows: np.ndarray, number: int, how: tuple[Level, ...]) -> Iterator[tuple[int, np.ndarray]]:
        """(list, rows in it) below a list."""
        if not how:
            yield number, rows
            return
        level = how[0]
        rng = np.random.default_rng((self.seed, number))
        for r in range(level.repetitions):
            strip = np.packbits(bits[np.ix_(rows, rng.permutation(BITS)[:STRIP])], axis=1).view(np.uint32).ravel()
            for c, centre in enumerate(rng.integers(0, 1 << 32, level.centres, np.uint32)):
                near = np.flatnonzero(np.bitwise_count(strip ^ centre) <= level.bound)
                if len(near):
                    yield from self._descend(bits, rows[near], _below(number, r * level.centres + c), how[1:])

    def whole(self, high: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if len(high):
            bits = np.unpackbits(np.stack([high, low], 1).view(np.uint8), axis=1)
            yield from self._descend(bits, np.arange(len(high)), 1, self.how)

    def near(self, hot: Hot, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which are within the distance of the pivot; the pivot itself belongs to the rest."""
        apart = np.bitwise_count(high ^ hot.high) + np.bitwise_count(low ^ hot.low)
        return (apart <= self.distance) & (apart > 0)

    def members(self, high: np.ndarray, low: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(list, rows in it, whether they only meet those for which this is false)."""
        for number, rows in self.whole(high, low):
            hot = self.hot.get(number)
            if not hot:
                yield number, rows, False
                continue
            close = self.near(hot, high[rows], low[rows])
            part = mix(high[rows] ^ mix(low[rows]))
            rest, own = rows[~close], (part[~close] % np.uint64(hot.rest_parts)).astype(np.int64)
            for k in range(hot.rest_parts):
                some = rest[own == k]
                for p in range(hot.near_parts):
                    yield _below(number, p * hot.rest_parts + k), some, False
                for j in range(hot.rest_parts if hot.rest_parts > 1 else 0):
                    yield _below(number, (hot.near_parts + min(k, j)) * hot.rest_parts + max(k, j)), some, False
            for p in range(hot.near_parts):
                some = rows[close][part[close] % np.uint64(hot.near_parts) == p]
                for k in range(hot.rest_parts):
                    yield _below(number, p * hot.rest_parts + k), some, True


def close_in(high: np.ndarray, low: np.ndarray, distance: int, first: int | None = None, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of the pairs of a list within the distance, by brute force; those after the `first`
    aren't compared with one another."""
    n, held = len(high), 0
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate(e) for e in zip(*edges)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        root = joined(n, x, y)
        moved = np.flatnonzero(root != np.arange(n))
        return moved, root[moved]

    for i in range(0, n if first is None else first, block):
        h, l = high[i : i + block, None], low[i : i + block, None]
        for j in range(i, n, block):
            apart = np.bitwise_count(h ^ high[None, j : j + block]) + np.bitwise_count(l ^ low[None, j : j + block])
            a, b = np.nonzero(apart <= distance)
            a, b = a + i, b + j
            some = a < b
            edges.append((a[some], b[some]))
            held += len(edges[-1][0])
            if held > 1 << 20:
                edges = [fold()]
                held = len(edges[0][0])
    return fold()


def hot_lists(nodes: DataFrame, lists: Lists, hot: int) -> dict[int, Hot]:
    """The lists of over `hot`, by number: at most as many as there are list entries, over `hot`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(number, len(rows)) for number, rows in lists.whole(*(ids(b, k).view(np.uint64) for k in ("high", "low")))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["list", "n"])

    sizes = {r["list"]: r["n"] for r in nodes.mapInArrow(tidy(count), "list bigint, n bigint").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > hot).collect()}
    if not sizes:
        return {}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            high, low = (ids(b, k).view(np.uint64) for k in ("high", "low"))
            found = []
            for number, rows in lists.whole(high, low):
                for k in range(PIVOTS if number in sizes else 0):
                    order = mix(high[rows] ^ mix(low[rows] + np.uint64(k))).view(np.int64)
                    at = int(order.argmin())
                    found.append((number, k, int(order[at]), int(high[rows[at]].view(np.int64)), int(low[rows[at]].view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(5)], names=["list", "k", "o", "high", "low"])

    drawn = nodes.mapInArrow(tidy(draw), "list bigint, k bigint, o bigint, high bigint, low bigint").groupBy("list", "k").agg(F.min(F.struct("o", "high", "low")).alias("p")).select("list", "p.high", "p.low").collect()
    pivots: dict[int, list[Hot]] = {}
    for r in drawn:
        pivots.setdefault(r["list"], []).append(Hot(*(np.array([r[k]], np.int64).view(np.uint64)[0] for k in ("high", "low")), 1, 1))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            high, low = (ids(b, k).view(np.uint64) for k in ("high", "low"))
            found = [(number, k, int(lists.near(p, high[rows], low[rows]).sum())) for number, rows in lists.whole(high, low) for k, p in enumerate(pivots.get(number, []))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["list", "k", "n"])

    best = nodes.mapInArrow(tidy(cover), "list bigint, k bigint, n bigint").groupBy("list", "k").agg(F.sum("n").alias("n")).groupBy("list").agg(F.max(F.struct("n", "k")).alias("m")).select("list", "m.n", "m.k").collect()
    out = {}
    for r in best:
        rest_parts = math.ceil(2 * (sizes[r["list"]] - r["n"]) / hot)
        pivot = pivots[r["list"]][r["k"]]
        out[r["list"]] = Hot(pivot.high, pivot.low, math.ceil(2 * r["n"] / hot), max(1, rest_parts))
    return out


def close_edges(nodes: DataFrame, distance: int = DISTANCE, recall: float = RECALL, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between nodes (node, high, low), through which any two nodes with fingerprints at most `distance` apart
    are connected, at the target recall."""
    n = nodes.count()
    lists = Lists(plan(n, distance, recall), distance, seed)
    lists.hot = hot_lists(nodes, lists, hot)
    entries = n
    for level in lists.how:
        entries *= level.repetitions * max(1, level.centres * level.share)
    buckets = max(partitions(nodes.sparkSession), math.ceil(entries / 100_000))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A list's number is doubled to hold whether its rows are near the pivot.
        blocks = Blocks(0, {k: pa.int64() for k in ("list", "node", "high", "low")})
        for b in batches:
            node, high, low = (ids(b, k) for k in ("node", "high", "low"))
            for number, rows, near in lists.members(high.view(np.uint64), low.view(np.uint64)):
                if len(rows):
                    own = np.full(len(rows), number, np.int64)
                    bucket = (mix(own.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                    yield from blocks.add(bucket, own * 2 + near, node[rows], high[rows], low[rows])
        yield from blocks.close()

    def compare(table: pa.Table) -> pa.Table:
        lists, node, high, low = (np.concatenate([c.flatten().to_numpy() for c in table.column(k).chunks]) for k in ("list", "node", "high", "low"))
        order = np.lexsort((node, lists))
        lists, node, high, low = lists[order], node[order], high[order].view(np.uint64), low[order].view(np.uint64)
        near, lists = lists & 1, lists >> 1
        cut = np.append(np.flatnonzero(np.diff(lists, prepend=lists[0] - 1)), len(lists))
        found = [(node[s:e][a], node[s:e][b]) for s, e in zip(cut[:-1], cut[1:]) for a, b in (close_in(high[s:e], low[s:e], distance, int(e - s - near[s:e].sum())),)]
        a, b = (np.concatenate(x) for x in zip(*found))
        # One forest for all lists of the bucket.
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = joined(len(names), at[: len(a)], at[len(a) :])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[root[moved]], "b": names[moved]})

    kinds = ", ".join(f"{k} array<bigint>" for k in ("list", "node", "high", "low"))
    return nodes.mapInArrow(tidy(send), f"bucket int, {kinds}").groupBy("bucket").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, recall: float = RECALL) -> DataFrame:
    """(doc_id, kept_doc_id): each document that has a near-duplicate with a lesser id in its group, with the one that stays.

    A group is a connected component of the pairs whose fingerprints differ in at most `distance` of 128 bits.
    """
    prints = written(fingerprint_table(docs, id_col, text_col).groupBy("doc_id").agg(F.min(F.struct("high", "low")).alias("f")).select("doc_id", "f.high", "f.low"), "prints")
    nodes = written(prints.groupBy("high", "low").agg(F.min("doc_id").alias("node")), "nodes")
    roots = small(written(components(written(close_edges(nodes, distance, recall), "edges")), "roots"))
    kept = prints.join(nodes.withColumnRenamed("high", "h").withColumnRenamed("low", "l"), (F.col("high") == F.col("h")) & (F.col("low") == F.col("l"))).select("doc_id", "node")
    kept = kept.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    return kept.select("doc_id", F.coalesce("root", "node").alias("kept_doc_id")).where("doc_id <> kept_doc_id")
