"""Exact top-k search by inner product over multi-resolution segment statistics.

A vector's dimensions are cut into segments. With m dimensions, mean u and deviation s in a segment, two
vectors are at least sqrt(sum m ((u - u')^2 + (s - s')^2)) apart, and this bound gets closer with more
segments. As a vector's norm is also sum m (u^2 + s^2), a lower bound on the distance is an upper bound on
the inner product: the product of the vectors (sqrt(m) u, sqrt(m) s). Each pair of a query and a row is
held against the query's k-th best score so far, coarse level first, and only survivors are multiplied out.

Queries are a share of the rows, so they go block by block: a block is broadcast, each task runs its rows
past it, and the block's result is in the shared folder before the next block starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import new_path, remove, split_into

#: Segments of each level; queries of a block, and bytes of their vectors; rows for first thresholds.
LEVELS, QUERY_BLOCK, QUERY_BYTES, SEEDS = (4, 16), 4096, 64 << 20, 4096
#: Rows and queries that are held against each other at once.
ROW_BLOCK, AT_ONCE = 8192, 256
#: Up to here doubles hold integers, and sums of them, exactly.
EXACT = float(1 << 52)
LEAST_SCORE, MOST_SCORE = -(1 << 63), (1 << 63) - 1


def integers(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, floor(scale * vector), as doubles, and row numbers of the usable rows of a batch, by dimension."""
    lists = batch["vector"]
    lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    with np.errstate(over="ignore"):
        flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = (bad[ends] == bad[ends - lengths]) & lists.is_valid().to_numpy(zero_copy_only=False) & batch["id"].is_valid().to_numpy(zero_copy_only=False)
    ids = np.nan_to_num(batch["id"].to_numpy(zero_copy_only=False)) if batch["id"].null_count else batch["id"].to_numpy()
    for dim in np.unique(lengths[usable]):
        own = np.flatnonzero(usable & (lengths == dim))
        at = (ends[own] - dim)[:, None] + np.arange(dim)
        yield ids[own].astype(np.int64), flat[at], own


def segments(x: np.ndarray, parts: int) -> np.ndarray:
    """sqrt(m) * mean and sqrt(m) * deviation of each segment of each row."""
    edges = np.unique(np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int))
    if x.shape[1] == 0:
        return np.zeros((len(x), 0))
    m = np.diff(edges)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / m
    square = np.add.reduceat((x - np.repeat(mean, m, axis=1)) ** 2, edges[:-1], axis=1) / m
    return np.hstack([mean, np.sqrt(square)]) * np.sqrt(np.concatenate([m, m]))


def dots(q: np.ndarray, x: np.ndarray, alive: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and exact inner product of the pairs that are alive, if it is the query's least or more;
    beyond a long's range, its end."""
    if not q.shape[1] or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT:
        if 16 * np.count_nonzero(alive) >= alive.size:
            scores = q @ x.T
            which, row = np.nonzero(alive & (scores >= least[:, None]))
            return which, row, scores[which, row].astype(np.int64)
        which, row = np.nonzero(alive)
        return which, row, np.einsum("ij,ij->i", q[which], x[row]).astype(np.int64)
    which, row = np.nonzero(alive)
    whole = [[int(v) for v in r] for r in q.tolist()], [[int(v) for v in r] for r in x.tolist()]
    scores = (sum(a * b for a, b in zip(whole[0][i], whole[1][j])) for i, j in zip(which.tolist(), row.tolist()))
    return which, row, np.array([min(max(s, LEAST_SCORE), MOST_SCORE) for s in scores], np.int64)


class Best:
    """The k best (score, id) of each of n queries, ties to the smaller id. least: the score that a
    query's k-th best is known to have at least."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.score, self.id, self.there = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.least = np.full(n, -np.inf) if least is None else least.copy()

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some, k = np.unique(query), self.score.shape[1]
        if not len(some):
            return
        kept = np.nonzero(self.there[some])
        q = np.concatenate([some[kept[0]], query])
        s, i = np.concatenate([self.score[some][kept], score]), np.concatenate([self.id[some][kept], ids])
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        top = rank < k
        at = q[top], rank[top]
        self.score[at], self.id[at], self.there[at] = s[top], i[top], True
        last = rank == k - 1
        self.least[q[last]] = np.maximum(self.least[q[last]], s[last])


def search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best, which: np.ndarray, levels: tuple[int, ...]) -> np.ndarray:
    """Rows x against queries: adds to best what may be among the k best. which: the queries' numbers.

    Returns the pairs, and how many of them outlive each level.
    """
    outlive = np.zeros(len(levels) + 1, np.int64)
    if not len(queries) or not len(x):
        return outlive
    with np.errstate(over="ignore", invalid="ignore"):
        features = [(segments(queries, p), segments(x, p)) for p in levels]
        slack = 1e-9 * (1 + np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max())
        for a in range(0, len(queries), AT_ONCE):
            sub = slice(a, a + AT_ONCE)
            least = best.least[which[sub]] - np.nan_to_num(slack[sub], nan=np.inf, posinf=np.inf)
            rows, alive = np.arange(len(x)), own[sub][:, None] != ids
            outlive[0] += alive.sum()
            for level, (fq, fx) in enumerate(features):
                # a bound that is no number, of components too large to square, prunes nothing
                alive &= ~(fq[sub] @ fx[rows].T < least[:, None])
                some = alive.any(axis=0)
                rows, alive = rows[some], alive[:, some]
                outlive[level + 1] += alive.sum()
            q, r, score = dots(queries[sub], x[rows], alive, best.least[which[sub]])
            best.add(which[sub][q], score, ids[rows][r])
    return outlive


#: Queries by dimension: their numbers, ids and vectors.
Asked = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_dimension(batches: list[pa.RecordBatch], scale: int) -> tuple[Asked, np.ndarray, np.ndarray]:
    """Queries by dimension, and the id and first threshold of each number."""
    parts = [(ids, x, b["least"].to_numpy()[own]) for b in batches for ids, x, own in integers(b, scale)]
    asks, names, least, at = {}, [], [], 0
    for dim in sorted({x.shape[1] for _, x, _ in parts}):
        mine = [p for p in parts if p[1].shape[1] == dim]
        ids = np.concatenate([i for i, _, _ in mine])
        asks[dim] = (np.arange(at, at + len(ids)), ids, np.concatenate([x for _, x, _ in mine]))
        names.append(ids)
        least.append(np.concatenate([t for _, _, t in mine]))
        at += len(ids)
    return asks, np.concatenate(names or [np.zeros(0, np.int64)]), np.concatenate(least or [np.zeros(0)])


def run_past(asks: Asked, batches: Iterator[pa.RecordBatch], best: Best, scale: int, levels: tuple[int, ...]) -> np.ndarray:
    """All rows of the batches against the queries; returns what search does, added up."""
    outlive = np.zeros(len(levels) + 1, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, ROW_BLOCK):
            for ids, x, _ in integers(batch.slice(a, ROW_BLOCK), scale):
                if x.shape[1] in asks:
                    which, own, queries = asks[x.shape[1]]
                    outlive += search(queries, own, x, ids, best, which, levels)
    return outlive


def top_k(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, k: int = 10, scale: int = 1024, levels: tuple[int, ...] = LEVELS, query_block: int = QUERY_BLOCK, seeds: int = SEEDS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows with the highest inner product for each query.

    Components are floor(scale * component). Queries are the rows where is_query holds (by default, id
    divisible by 100); candidates are all rows but those with the query's own id; ties go to the smaller
    id, and a query with fewer candidates gets all. Rows whose id or vector is null, or whose vector
    holds a null or a component that, scaled, isn't finite, take no part. A score beyond a long's range
    is held at its end, and ties with others there. Only vectors of one dimension are compared.
    A repeated row is a candidate each time, and a repeated query gives its result each time. An empty
    table gives an empty result.

    Each block of at most about query_block queries (fewer, if they have many dimensions) reads the rows
    once. First thresholds, which only prune, come from at most ``seeds`` rows and are found where the
    queries are.
    """
    spark = rows.sparkSession
    is_query = F.pmod(F.col(id), F.lit(100)) == 0 if is_query is None else is_query
    columns = [F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")]
    data, asked = rows.select(columns), rows.where(is_query).select(columns)
    there, doubles = asked.agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    if not there:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(split_into(there, query_block), split_into(max(0, doubles or 0) * 8, QUERY_BYTES))
    first = spark.sparkContext.broadcast(data.limit(seeds).toArrow().to_batches())

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.full(batch.num_rows, -np.inf)
            for ids, x, own in integers(batch, scale):
                best = Best(len(ids), k)
                run_past({x.shape[1]: (np.arange(len(ids)), ids, x)}, first.value, best, scale, levels)
                least[own] = best.least
            yield batch.append_column("least", pa.array(least))

    # dealt by row, not by id: an id may be repeated however often
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    folder, out = new_path(spark, "queries"), new_path(spark, "top-k")
    asked = asked.mapInArrow(first_thresholds, "id long, vector array<double>, least double")
    asked.withColumn("block", block).repartition(blocks, "block").write.partitionBy("block").option("compression", "zstd").parquet(folder)
    first.destroy()
    fields = "query int, query_id long, vec_id long, score long"
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    for number in range(blocks):
        mine = spark.read.schema("id long, vector array<double>, least double, block long").parquet(folder).where(F.col("block") == number)
        shared = spark.sparkContext.broadcast(by_dimension(mine.toArrow().to_batches(), scale))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asks, names, least = shared.value
            best = Best(len(names), k, least)
            run_past(asks, batches, best, scale, levels)
            q, r = np.nonzero(best.there)
            columns = [pa.array(q.astype(np.int32)), *(pa.array(c) for c in (names[q], best.id[q, r], best.score[q, r]))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "score"])

        ranked = data.mapInArrow(run, fields).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        shared.destroy()
    remove(spark, folder)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(out)
