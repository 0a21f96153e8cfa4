"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

The largest inner product is made a nearest distance: each vector x gets one more component sqrt(M^2 - |x|^2), M the
largest norm of all rows, and each query is scaled to norm M with 0 there. A table hashes a vector to the cell
(floor((a_i . x + b_i) / w))_i with normal a_i. For a query and a neighbour of similarity r = q.x / M^2 the projection
of the neighbour is normal with mean r (a_i . q) and variance M^2 (1 - r^2), so the success estimate of a cell is a product
of normal probabilities. A query visits cells from the most to the least likely one until they hold the share of success that
brings all tables together to the target; that share is found as a quantile over drawn neighbours, so the order
never has to be listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trialweave.session import scratch_path

#: Queries that go to every task at once, vectors compared with them at once, and draws for a quantile.
BLOCK, CHUNK, DRAWS = 1024, 4096, 128
#: Queries whose true neighbours are found to fit the similarity that the index must reach.
FIT_QUERIES = 64
_CELLS = 12


@dataclass(frozen=True)
class Index:
    """Parameters of the tables; the cells of the vectors are computed where the vectors are."""

    dimension: int
    norm: float
    reach: float
    tables: int = 4
    hashes: int = 10
    width: float = 1.0
    target: float = 0.92
    seed: int = 7

    def projections(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed)
        return draw.standard_normal((self.tables, self.hashes, self.dimension + 1)), draw.random((self.tables, self.hashes))

    def cells(self, values: np.ndarray, shifts: np.ndarray) -> np.ndarray:
        """Cell numbers 0 .. _CELLS - 1; the outermost ones are open to infinity."""
        return np.clip(np.floor(values / (self.width * self.norm) + shifts).astype(np.int64) + _CELLS // 2, 0, _CELLS - 1)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """To 1e-7, which orders cells; scores never use it."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x >= 0, 1 - tail, tail)


class Block:
    """A block of queries with its success estimates for each table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, index: Index | None) -> None:
        self.ids, self.vectors, self.index = ids, vectors, index
        if index is None:
            return
        self.directions, self.shifts = index.projections()
        scaled = vectors * (index.norm / np.linalg.norm(vectors, axis=1))[:, None]
        spread = index.norm * math.sqrt(max(1e-12, 1 - index.reach**2))
        share = 1 - (1 - index.target) ** (1 / index.tables)
        edges = (np.arange(_CELLS + 1) - _CELLS // 2).astype(float)
        edges[0], edges[-1] = -1e9, 1e9
        draw = np.random.default_rng(index.seed + 1)
        self.success, self.least = [], []
        for t in range(index.tables):
            centre = index.reach * (scaled @ self.directions[t][:, :-1].T)
            bounds = (edges[None, None, :] - self.shifts[t][None, :, None]) * index.width * index.norm
            log = np.log(np.maximum(np.diff(_normal_cdf((bounds - centre[:, :, None]) / spread), axis=2), 1e-12)).astype(np.float32)
            drawn = index.cells(centre[:, :, None] + spread * draw.standard_normal((1, index.hashes, DRAWS)), self.shifts[t][None, :, None])
            of_draws = np.take_along_axis(log, drawn, axis=2).sum(axis=1)
            self.success.append(log)
            self.least.append(np.quantile(of_draws, 1 - share, axis=1) - 1e-4)

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        """(queries, vectors): whether the query visits a cell of the vector in any table."""
        index = self.index
        if index is None:
            return np.ones((len(self.ids), len(vectors)), bool)
        last = np.sqrt(np.maximum(0, index.norm**2 - np.einsum("ij,ij->i", vectors, vectors)))
        visited = np.zeros((len(self.ids), len(vectors)), bool)
        for t in range(index.tables):
            a = self.directions[t]
            cells, of_vector = np.unique(index.cells(vectors @ a[:, :-1].T + last[:, None] * a[:, -1], self.shifts[t]), axis=0, return_inverse=True)
            log = sum(self.success[t][:, i, cells[:, i]] for i in range(index.hashes))
            visited |= (log >= self.least[t][:, None])[:, of_vector.ravel()]
        return visited

    def best(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of each query's k best candidates; ties go to the smaller id."""
        scores = self.vectors @ vectors.T
        scores[~self.candidates(vectors) | (self.ids[:, None] == ids[None, :])] = -np.inf
        n = scores.shape[1]
        worst = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
        slack = 1e-9 * np.linalg.norm(self.vectors, axis=1) * (np.linalg.norm(vectors, axis=1).max() if n else 0)
        query, of = np.nonzero((scores >= (worst - slack)[:, None]) & (scores > -np.inf))
        exact = np.empty(len(query))
        for low in range(0, len(query), 100_000):
            part = slice(low, low + 100_000)
            exact[part] = (self.vectors[query[part]] * vectors[of[part]]).sum(axis=1)
        return top(query, ids[of], exact, k)


def top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    if not len(query):
        return query, ids, scores
    first = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, n) of the rows that take part: an id, and a vector that is not null, empty or zero and has finite components only."""
    v = F.col(vector).cast("array<double>")
    return (
        vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .where(F.exists("v", lambda x: x != 0))
        .withColumn("n", F.size("v"))
    )


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _scan(rows: DataFrame, dimension: int, block: tuple[np.ndarray, np.ndarray], index: Index | None, k: int) -> DataFrame:
    """Each task's k best of all its rows for each query of the block, merged over the tables and the task's batches."""
    shared = rows.sparkSession.sparkContext.broadcast((*block, index))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Block(*shared.value)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for part in parts:
            ids, vectors = part.column(0).to_numpy(), _matrix(part.column(1), dimension)
            for low in range(0, len(ids), CHUNK):
                new = queries.best(ids[low : low + CHUNK], vectors[low : low + CHUNK], k)
                found = top(*(np.concatenate(x) for x in zip(found, new)), k)
        query, ids, scores = found
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(queries.ids[query]), pa.array(ids), pa.array(scores)], names=["q", "query_id", "id", "score"])

    return rows.select("id", "v").mapInArrow(search, "q long, query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("b", "q").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _collect(queries: DataFrame, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    rows = queries.select("id", "v").collect()
    return np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows], np.float64).reshape(-1, dimension)


def fit(rows: DataFrame, queries: DataFrame, dimension: int, k: int, **settings) -> Index:
    """An index for these rows: the largest norm of all of them, and the similarity that nine in ten of `FIT_QUERIES` queries (those
    with the smallest hash) need for all k neighbours, found by comparing them with every row."""
    norm = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    block = _collect(queries.orderBy(F.xxhash64("id", "v"), "id").limit(FIT_QUERIES), dimension)
    found = _ranked(_scan(rows, dimension, block, None, k).withColumn("b", F.lit(0)), k)
    lengths = np.linalg.norm(block[1], axis=1)
    weakest = [r.s / (lengths[r.q] * norm) for r in found.groupBy("q").agg(F.min("score").alias("s")).collect()]
    return Index(dimension, norm, float(np.clip(np.quantile(weakest or [0.5], 0.1), 0.05, 0.999)), **settings)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found rows of each query row, by inner product in double precision.

    `is_query` is a condition over `id`. Every row but those with the query's own id is a candidate; ties go to the smaller id; with fewer
    candidates there are fewer rows. Rows without an id, and vectors that are null, empty, zero or not finite, take no part;
    vectors of different lengths are searched apart. Equal query rows are one query. No queries or no rows: no result.

    Queries go to the tasks in blocks of about `BLOCK`, the rows stay where they are and only each task's k best for a query are shuffled,
    so many copies of a vector need no split. Blocks are written one after the other, so the driver holds one.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    queries = rows.where(is_query).dropDuplicates(["id", "v"])
    path = scratch_path(spark, "neighbours")
    schema = "q long, query_id long, id long, score double, b int"
    spark.createDataFrame([], schema).write.parquet(path)
    at = 0
    for dimension, count in sorted(tuple(r) for r in queries.groupBy("n").count().collect()):
        mine, asked = rows.where(F.col("n") == dimension), queries.where(F.col("n") == dimension)
        index = fit(mine, asked, dimension, k, **settings)
        blocks = -(-count // BLOCK)
        for b in range(blocks):
            block = _collect(asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b), dimension)
            if len(block[0]):
                _scan(mine, dimension, block, index, k).withColumn("b", F.lit(at)).write.mode("append").parquet(path)
            at += 1
    found = _ranked(spark.read.schema(schema).parquet(path), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
