"""Exact top-k search by tiled matrix products.

Queries are the rows whose id is divisible by EVERY, and are searched for among all rows. Queries are cut by a hash of
their id into blocks and all vectors into groups, both of about TILE_BYTES in double precision; every block meets every
group, tile by tile. So a vector is sent as often as there are blocks of queries, and a query as often as there are
groups. A product of two tiles gives all similarities of their vectors; of each row only those that reach its k-th best
are kept (partial selection, with all ties), and a query's lists are merged pair by pair, first within the task and then,
in a second step, over the groups.

Similarity is the cosine in double precision, rounded to DIGITS digits for ranking, so that equal vectors tie; ties go to
the lesser id. A query itself is left out of its list.

Defined cases: null or empty vectors, those with a null, NaN or infinite number, and zero vectors have no direction and take
no part; vectors of another length than the query's are no neighbours of it; rows that repeat an id are one vector
(the least); rows without an id are left out; with fewer than k others a query has as many rows as there are; an empty
table, or one without a query, gives an empty result; only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written

K = 10
EVERY = 20
DIGITS = 10
TILE = 2048
TILE_BYTES = 64 << 20


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the usable vectors, one for each id."""
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col(f"`{vector_col}`").cast(kind)
    usable = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return usable.where(fine).groupBy("id").agg(F.min("v").alias("v"))


def matrix(table: pa.Table, names: tuple[str, str] = ("id", "v")) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors), by id."""
    own = np.concatenate([c.to_numpy() for c in table.column(names[0]).chunks])
    flat = np.concatenate([c.flatten().to_numpy() for c in table.column(names[1]).chunks])
    v = flat.astype(np.float64).reshape(len(own), -1)
    # A power of two first, which is exact: no square overflows or vanishes.
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])
    order = np.argsort(own)
    return own[order], (v / np.sqrt((v * v).sum(1))[:, None])[order]


def merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The best k of both (query row, score, id) lists for each query, best first."""
    row, score, other = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((other, -score, row))
    row, score, other = row[order], score[order], other[order]
    head = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - head < k
    return row[keep], score[keep], other[keep]


def tree_merge(lists: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    while len(lists) > 1:
        lists = [merge(lists[i], lists[i + 1], k) if i + 1 < len(lists) else lists[i] for i in range(0, len(lists), 2)]
    return lists[0]


def best_of(q_ids: np.ndarray, q: np.ndarray, s_ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Top-k lists of the queries over one tile."""
    score = np.round(q @ s.T, DIGITS)
    score[q_ids[:, None] == s_ids[None, :]] = -np.inf
    if len(s_ids) > k:
        bound = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero((score >= bound) & (score > -np.inf))
    else:
        row, col = np.nonzero(score > -np.inf)
    return merge((row, score[row, col], s_ids[col]), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), k)


def search(rows: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(query_id, rank, neighbour_id, similarity) of the k nearest of every vector whose id is divisible by `every`."""
    spark = rows.sparkSession
    own = written(vectors(rows, id_col, vector_col), "vectors")
    asked = F.pmod(F.col("id"), F.lit(every)) == 0
    n, n_queries, wide = own.agg(F.count("*"), F.count_if(asked), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = max(1, tile_bytes // (8 * wide))
    blocks = max(1, math.ceil(n_queries / block))
    # Enough groups for the cluster's tasks, but none of less than a tile.
    groups = max(1, math.ceil(n / block), min(math.ceil(n / tile), math.ceil(2 * partitions(spark) / blocks)))
    sized = own.withColumn("dim", F.size("v"))
    queries = sized.where(asked).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shards = sized.withColumn("group", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    shards = shards.select(F.col("block").alias("at"), F.col("dim").alias("size"), F.col("group").alias("part"), F.col("id").alias("s_id"), F.col("v").alias("s_v"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q_ids, q = matrix(left)
        s_ids, s = matrix(right, ("s_id", "s_v"))
        found = []
        for j in range(0, len(q_ids), tile // 2):
            lists = [best_of(q_ids[j : j + tile // 2], q[j : j + tile // 2], s_ids[i : i + tile], s[i : i + tile], k) for i in range(0, len(s_ids), tile)]
            row, score, other = tree_merge(lists, k)
            found.append((q_ids[j + row], other, score))
        query, other, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query_id": query, "neighbour_id": other, "similarity": score})

    met = queries.groupBy("block", "dim", "group").cogroup(shards.groupBy("at", "size", "part")).applyInArrow(product, "query_id bigint, neighbour_id bigint, similarity double")

    def last(table: pa.Table) -> pa.Table:
        q, other, score = (np.concatenate([c.to_numpy() for c in table.column(c_).chunks]) for c_ in ("query_id", "neighbour_id", "similarity"))
        row, score, other = merge((q, score, other), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)), k)
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left") + 1
        return pa.table({"query_id": row, "rank": rank.astype(np.int32), "neighbour_id": other, "similarity": np.round(score, 6) + 0.0})

    part = met.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(math.ceil(n_queries / tile), partitions(spark)))).cast("int"))
    return part.groupBy("part").applyInArrow(last, "query_id bigint, rank int, neighbour_id bigint, similarity double")
