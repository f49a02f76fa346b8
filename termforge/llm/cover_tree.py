"""Embedding near-duplicates: all links of a cosine of at least a threshold, by dual traversal of cover trees.

On unit vectors a cosine is a distance. Equal vectors are one node that counts as often as they occur. Nodes go to the
nearest of n / cell pivots; a pivot's nodes, where they are many, are cut by a hash into cells of about as many. Every cell
is made a cover tree once, and stored: a tree's node covers a range of the cell's vectors, knows the distance from its
centre to the farthest of them, and its children are the centres of a net of half its radius or less, its own centre first.

Two cells meet unless the pivots' distance, less both covering radii, exceeds the threshold distance. Where they meet,
pairs of tree nodes are descended together, a cell with itself in one order only. A pair is dropped when the centres'
distance, less both radii, exceeds the threshold distance, and it is settled whole, without a look at what it covers, when
their distance and both radii together stay within it. So the result is exact, no number of partners is capped, and a
dense cluster costs its nodes, not its pairs. Centres are compared in single precision with a margin for its rounding;
what comes near the threshold is decided in double precision, rounded to DIGITS digits.

Defined cases: null or empty vectors, those with a null, NaN or infinite number, and zero vectors have no direction and are
in no class; vectors of different lengths aren't compared; rows that repeat an id are one vector (the least); rows without
an id are left out; equal vectors are linked; a vector without a link is a class of its own; an empty table gives an empty
result; only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, partitions, written
from .components import components, joined
from .kernels import ragged, tidy
from .ngram_corpus import load, save
from .topk import DIGITS, matrix, vectors

SIMILARITY = 0.95
LEAST_CELL, MOST_CELL = 4096, 65536
LEAF = 48
BLOCK = 2048
SLACK = 1e-7  # over the rounding of distances in double precision, so that bounds never drop a pair
ROUNDING = 2e-6  # over that of single products of unit vectors
TRIES = 1 << 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass
class Tree:
    """A cell in the order of its tree. Node k covers the vectors start[k] .. end[k] - 1, the first of which is its centre;
    its children are the nodes first[k] .. first[k] + children[k] - 1."""

    ids: np.ndarray
    times: np.ndarray
    v: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray

    def __post_init__(self) -> None:
        self.single = self.v.astype(np.float32)
        self.weight = np.concatenate([[0], np.cumsum(self.times)])


def build(ids: np.ndarray, times: np.ndarray, v: np.ndarray) -> Tree:
    """The cover tree of these vectors, from the first one on."""
    start, end, radius, first, children = [0], [len(v)], [0.0], [0], [0]
    away = distances(v[:1], v)[0]
    away[0] = 0.0
    open_ = [(0, np.arange(len(v)), away)]
    at = np.arange(len(v))
    while open_:
        node, members, away = open_.pop()
        radius[node] = float(away.max())
        begin = start[node]
        at[begin : begin + len(members)] = members
        scale = radius[node]
        if len(members) <= LEAF or scale <= SLACK:
            continue
        while not (away > scale).any():
            scale /= 2
        near = away <= scale
        rest = members[~near]
        owner, apart = _net(v, rest, scale)
        by = np.argsort(owner, kind="stable")
        heads = np.flatnonzero(np.diff(owner[by], prepend=-1))
        groups = [(members[near], away[near])]
        for a, b in zip(heads, np.append(heads[1:], len(by))):
            part = by[a:b]
            groups.append((rest[part], apart[part]))
        first[node], children[node] = len(start), len(groups)
        for own, dist in groups:
            # The centre is the first of its members.
            centre = int(dist.argmin())
            if centre:
                own, dist = (np.concatenate([x[centre : centre + 1], x[:centre], x[centre + 1 :]]) for x in (own, dist))
            k = len(start)
            start.append(begin)
            end.append(begin + len(own))
            begin += len(own)
            radius.append(0.0)
            first.append(0)
            children.append(0)
            if len(own) > 1:
                open_.append((k, own, dist))
            else:
                at[start[k]] = own[0]
    return Tree(ids[at], times[at], v[at], *(np.array(x, np.int64) for x in (start, end)), np.array(radius), *(np.array(x, np.int64) for x in (first, children)))


def _net(v: np.ndarray, rest: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(centre, distance from it) of each: the first that no earlier centre has within the scale is a centre itself."""
    owner, apart = np.full(len(rest), -1), np.zeros(len(rest))
    for s in range(0, len(rest), 512):
        open_ = np.flatnonzero(owner[s : s + 512] < 0) + s
        if not len(open_):
            continue
        later = np.flatnonzero(owner[s:] < 0) + s
        d = distances(v[rest[open_]], v[rest[later]])
        within = d <= scale
        within[np.arange(len(open_)), np.searchsorted(later, open_)] = True
        several = within.sum(1) > 1
        owner[open_[~several]] = open_[~several]
        for k in np.flatnonzero(several):
            i = open_[k]
            if owner[i] < 0:
                hit = np.flatnonzero(within[k])
                own = hit[owner[later[hit]] < 0]
                owner[later[own]], apart[later[own]] = i, d[k, own]
                owner[i], apart[i] = i, 0.0
    return owner, apart


def blocks(nodes: np.ndarray, radius: np.ndarray) -> Iterator[np.ndarray]:
    """Siblings, in runs that either have a radius or have none."""
    for part in (nodes[radius[nodes] > 0], nodes[radius[nodes] == 0]):
        for s in range(0, len(part), BLOCK):
            yield part[s : s + BLOCK]


class Links:
    """What the traversal of two trees finds: how often each vector is linked, and edges that join what is linked."""

    def __init__(self, a: Tree, b: Tree, same: bool, threshold: float, pairs: bool) -> None:
        self.a, self.b, self.same, self.threshold, self.pairs = a, b, same, threshold, pairs
        self.reach = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.left, self.right = np.zeros(len(a.ids) + 1, np.int64), np.zeros(len(b.ids) + 1, np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def edge(self, x: np.ndarray, y: np.ndarray) -> None:
        """Vectors of the left and of the right tree; as positions among both, or among the one tree that meets itself."""
        self.edges.append((x, y if self.same else y + len(self.a.ids)))
        self.held += len(x)
        if self.held > 1 << 20:
            self.fold()

    def fold(self) -> np.ndarray:
        """The least position that each is joined to."""
        n = len(self.a.ids) + (0 if self.same else len(self.b.ids))
        x, y = (np.concatenate(e) for e in zip(*self.edges)) if self.edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        root = joined(n, x, y)
        moved = np.flatnonzero(root != np.arange(n))
        self.edges, self.held = [(moved, root[moved])], len(moved)
        return root

    def whole(self, x: np.ndarray, y: np.ndarray) -> None:
        """All that these pairs of nodes cover is linked."""
        a, b = self.a, self.b
        own = self.same & (x == y)
        if self.pairs:
            for i, j, alike in zip(x.tolist(), y.tolist(), own.tolist()):
                p, q = np.arange(a.start[i], a.end[i]), np.arange(b.start[j], b.end[j])
                p, q = np.repeat(p, len(q)), np.tile(q, len(p))
                if alike:
                    p, q = p[p < q], q[p < q]
                self.keep(p, q, np.einsum("ij,ij->i", a.v[p], b.v[q]))
            return
        to_left, to_right = b.weight[b.end[y]] - b.weight[b.start[y]], a.weight[a.end[x]] - a.weight[a.start[x]]
        for sums, tree, node, amount in ((self.left, a, x, to_left), (self.left if self.same else self.right, b, y, np.where(own, 0, to_right))):
            np.add.at(sums, tree.start[node], amount)
            np.add.at(sums, tree.end[node], -amount)
        for tree, node, other, left in ((a, x, b.start[y], True), (b, y, a.start[x], False)):
            size = tree.end[node] - tree.start[node]
            every = ragged(tree.start[node], size)
            self.edge(*((every, np.repeat(other, size)) if left else (np.repeat(other, size), every)))

    def keep(self, p: np.ndarray, q: np.ndarray, similarity: np.ndarray) -> None:
        self.found.append((self.a.ids[p], self.b.ids[q], np.round(similarity, DIGITS)))

    def several(self, p: np.ndarray, q: np.ndarray) -> None:
        """Pairs of vectors that come near the threshold: decided in double precision. p is before q in a tree that meets itself."""
        for s in range(0, len(p), TRIES):
            i, j = p[s : s + TRIES], q[s : s + TRIES]
            exact = np.einsum("ij,ij->i", self.a.v[i], self.b.v[j])
            near = np.round(exact, DIGITS) >= self.threshold
            i, j = i[near], j[near]
            if not len(i):
                continue
            if self.pairs:
                self.keep(i, j, exact[near])
                continue
            for sums, at, amount in ((self.left, i, self.b.times[j]), (self.left if self.same else self.right, j, self.a.times[i])):
                np.add.at(sums, at, amount)
                np.add.at(sums, at + 1, -amount)
            self.edge(i, j)

    def leaves(self, x: int, y: int) -> None:
        a, b = self.a, self.b
        p, q = np.arange(a.start[x], a.end[x]), np.arange(b.start[y], b.end[y])
        if self.same and x == y:
            i, j = np.triu_indices(len(p), 1)
            self.several(p[i], q[j])
            if not self.pairs:
                np.add.at(self.left, p, a.times[p])
                np.add.at(self.left, p + 1, -a.times[p])
            return
        for s in range(0, len(p), BLOCK):
            for t in range(0, len(q), BLOCK):
                near = a.single[p[s : s + BLOCK]] @ b.single[q[t : t + BLOCK]].T >= np.float32(self.threshold - ROUNDING)
                i, j = np.nonzero(near)
                self.several(p[s + i], q[t + j])

    def settle(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Settles pairs of nodes that meet, as far as their bounds say; returns those to descend into."""
        a, b = self.a, self.b
        own = self.same & (x == y)
        away = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", a.v[a.start[x]], b.v[b.start[y]]), 0))
        away[own] = 0.0
        both = a.radius[x] + b.radius[y]
        lone = (a.end[x] - a.start[x] == 1) & (b.end[y] - b.start[y] == 1) & ~own
        self.several(a.start[x[lone]], b.start[y[lone]])
        # What covers itself has twice its radius between any two at most.
        inside = ~lone & ((away + both <= self.reach - SLACK) | own & (both == 0))
        self.whole(x[inside], y[inside])
        left = np.flatnonzero(~lone & ~inside & (own | (away - both <= self.reach + SLACK)))
        return list(zip(x[left].tolist(), y[left].tolist()))

    def run(self) -> Links:
        a, b = self.a, self.b
        stack = self.settle(np.zeros(1, np.int64), np.zeros(1, np.int64))
        while stack:
            x, y = stack.pop()
            if not a.children[x] and not b.children[y]:
                self.leaves(x, y)
                continue
            own = self.same and x == y
            # Nodes of one level are opened together.
            left = np.arange(a.first[x], a.first[x] + a.children[x]) if a.children[x] and (2 * a.radius[x] >= b.radius[y] or not b.children[y]) else np.array([x])
            right = np.arange(b.first[y], b.first[y] + b.children[y]) if b.children[y] and (2 * b.radius[y] >= a.radius[x] or not a.children[x]) else np.array([y])
            if own:
                stack += self.settle(left, left)
            rights = list(blocks(right, b.radius))
            for k, i in enumerate(blocks(left, a.radius)):
                for j in rights[k if own else 0 :]:
                    product = a.single[a.start[i]] @ b.single[b.start[j]].T
                    most = self.reach + SLACK
                    if a.radius[i[0]] or b.radius[j[0]]:
                        most = np.minimum((most + a.radius[i]).astype(np.float32)[:, None] + b.radius[j].astype(np.float32), np.float32(2))
                    near = product >= np.float32(1 - ROUNDING) - most * most / np.float32(2)
                    p, q = np.divmod(np.flatnonzero(near), len(j))
                    if own and i[0] == j[0]:
                        p, q = p[p < q], q[p < q]
                    for u in range(0, len(p), TRIES):
                        stack += self.settle(i[p[u : u + TRIES]], j[q[u : u + TRIES]])
        return self


LINKS = "id bigint, links bigint, root bigint"
PAIRS = "a bigint, b bigint, similarity double"


def links_of(found: Links) -> pa.Table:
    """(id, vectors linked with it, least position's id that it is joined to) of all that has a link in these two cells."""
    root = found.fold()
    ids = found.a.ids if found.same else np.concatenate([found.a.ids, found.b.ids])
    links = np.cumsum(found.left[:-1]) if found.same else np.concatenate([np.cumsum(found.left[:-1]), np.cumsum(found.right[:-1])])
    some = links > 0
    return pa.table({"id": ids[some], "links": links[some], "root": ids[root[some]]})


def pairs_of(found: Links) -> pa.Table:
    a, b, s = (np.concatenate(x) for x in zip(*found.found)) if found.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"a": a, "b": b, "similarity": s})


def nodes_of(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(own: id, v of every usable vector; nodes: id, times, v of every different one)."""
    own = written(vectors(rows, id_col, vector_col), "vectors")
    return own, written(own.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("times")), "nodes")


def traversed(nodes: DataFrame, threshold: float, cell: int | None, pairs: bool) -> DataFrame:
    """The links (or the pairs) of all cells that meet, one length of vectors after the other."""
    out = nodes.sparkSession.createDataFrame([], PAIRS if pairs else LINKS)
    for dim, n in sorted(tuple(r) for r in nodes.groupBy(F.size("v")).count().collect()):
        out = out.union(_traversed(nodes.where(F.size("v") == dim), n, threshold, cell, pairs))
    return out


def _traversed(nodes: DataFrame, n: int, threshold: float, cell: int | None, pairs: bool) -> DataFrame:
    spark = nodes.sparkSession
    # Cells that keep all tasks busy with the pairs of cells, within bounds for a task's memory and the number of pivots.
    cell = cell or min(MOST_CELL, max(LEAST_CELL, math.ceil(n / math.sqrt(2 * partitions(spark)))))
    chosen = nodes.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(math.ceil(n / cell)).toArrow()
    _, pivots = matrix(chosen)
    # A vector for each `cell` of the table's; that is what the driver and the tasks hold of it.
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).sort_by("id")
            _, v = matrix(t)
            d = distances(v, shared.value)
            at = d.argmin(1)
            yield from t.append_column("pivot", pa.array(at.astype(np.int32))).append_column("away", pa.array(d[np.arange(len(at)), at])).to_batches()

    kind = nodes.schema["v"].dataType.simpleString()
    placed = written(nodes.select("id", "times", "v").mapInArrow(tidy(assign), f"id bigint, times bigint, v {kind}, pivot int, away double"), "placed")
    stats = sorted(map(tuple, placed.groupBy("pivot").agg(F.count("*"), F.max("away")).collect()))
    pivot = np.array([s[0] for s in stats], np.int64)
    parts = np.array([math.ceil(s[1] / cell) for s in stats], np.int64)
    radius = np.array([s[2] for s in stats])
    # A pivot's cells are numbered from its base on.
    base = np.cumsum(parts) - parts
    info = spark.createDataFrame([(int(p), int(k), int(b)) for p, k, b in zip(pivot, parts, base)], "at int, parts int, base int")
    folder = new_path(spark, "trees")

    def plant(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, v = matrix(table)
        times = np.concatenate([c.to_numpy() for c in table.column("times").chunks])
        t = build(ids, times, v)
        name = save(folder, ids=t.ids, times=t.times, v=t.v.ravel(), start=t.start, end=t.end, radius=t.radius, first=t.first, children=t.children)
        return pa.table({"cell": table.column("cell").slice(0, 1), "name": [name]})

    cells = placed.join(F.broadcast(info), F.col("pivot") == F.col("at")).select("id", "times", "v", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("cell"))
    trees = written(cells.groupBy("cell").applyInArrow(plant, "cell int, name string"), "trees")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 2 * SLACK
    near = spark.sparkContext.broadcast((pivot, parts, base, radius))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, parts, base, radius = near.value
        for b in batches:
            for k in b.column("id").to_pylist():
                meets = np.flatnonzero(distances(shared.value[pivot[k : k + 1]], shared.value[pivot])[0] <= reach + radius[k] + radius)
                meets = meets[meets >= k]
                other = ragged(base[meets], parts[meets])
                own = np.arange(base[k], base[k] + parts[k])
                x, y = np.repeat(own, len(other)), np.tile(other, len(own))
                yield pa.RecordBatch.from_arrays([pa.array(x[x <= y].astype(np.int32)), pa.array(y[x <= y].astype(np.int32))], names=["x", "y"])

    met = spark.range(len(pivot)).mapInArrow(meet, "x int, y int")
    one, two = (trees.select(F.col("cell").alias(k), F.col("name").alias(f"name_{k}")) for k in "xy")
    met = written(met.join(one, "x").join(two, "y"), "meets")
    n_met = met.count()

    def read(name: str) -> Tree:
        kept = load(folder, name)
        kept["v"] = kept["v"].reshape(len(kept["ids"]), -1)
        return Tree(**kept)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, Tree] = {}
        for b in batches:
            for x, y in sorted(zip(b.column("name_x").to_pylist(), b.column("name_y").to_pylist())):
                last = {k: last.get(k) or read(k) for k in {x, y}}
                found = Links(last[x], last[y], x == y, threshold, pairs).run()
                yield from (pairs_of(found) if pairs else links_of(found)).to_batches(1 << 16)

    spread = met.repartition(max(1, min(n_met, max(4 * partitions(spark), n_met // 4))), "x", "y")
    return spread.mapInArrow(tidy(descend), PAIRS if pairs else LINKS)


def near_classes(rows: DataFrame, threshold: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding", cell: int | None = None) -> DataFrame:
    """(vec_id, class_id, n_links) of every usable vector: the least id that links lead to, and how many others it is linked with."""
    own, nodes = nodes_of(rows, id_col, vector_col)
    found = written(traversed(nodes, threshold, cell, False), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(written(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")), "edges"))
    classes = nodes.select("id", "v").join(links, "id").join(roots, F.col("id") == F.col("node"), "left").select("v", F.coalesce("root", "id").alias("class_id"), (F.col("links") - 1).alias("n_links"))
    return own.join(classes, "v").select(F.col("id").alias("vec_id"), "class_id", "n_links")


def near_pairs(rows: DataFrame, threshold: float = SIMILARITY, id_col: str = "vec_id", vector_col: str = "embedding", cell: int | None = None) -> DataFrame:
    """(vec_a, vec_b, similarity) of every pair vec_a < vec_b of different vectors of a cosine of at least the threshold; of
    equal vectors the one with the least id stands for all."""
    _, nodes = nodes_of(rows, id_col, vector_col)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return traversed(nodes, threshold, cell, True).select(low.alias("vec_a"), high.alias("vec_b"), F.round("similarity", 6).alias("similarity"))
