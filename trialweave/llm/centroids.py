"""Centroid clustering in integers, with an incremental distance matrix.

Each vector keeps its exact dot products with all centroids. A round turns the sums of each cluster into new centroids and changes the dot products
only by the components in which a centroid differs from before; the squared distance to a centroid is |x|^2 - 2 x.c + |c|^2, so the argmin follows without
another look at the other components. The state of a round is a table in the shared folder; the one before it is deleted.
The driver holds the centroids and the sums of each cluster, k times the dimension, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialweave.session import cut_lineage, discard

#: Components beyond this would let a squared distance of 2^12 dimensions leave 64 bits.
LARGEST = 1 << 24


@dataclass(frozen=True)
class Clusters:
    """vectors: (id, cluster, distance), the table of the last round; centroids: one row of integers for each cluster."""

    vectors: DataFrame
    centroids: list[list[int]]


def integers(vectors: DataFrame, key: str, vector: str, dimension: int, scale: int = 1024) -> DataFrame:
    """(id, v) with v = floor(scale * x) of the vectors of exactly that many components, none null or not finite."""
    v = F.col(vector).cast("array<double>")
    out = vectors.select(F.col(key).alias("id"), v.alias("x")).where((F.size("x") == dimension) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fits = F.forall("x", lambda x: F.abs(x * scale) < LARGEST)
    checked = F.when(fits, F.transform("x", lambda x: F.floor(x * scale).cast("int"))).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("array<int>"))
    return out.select("id", checked.alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str = "3") -> list[list[int]]:
    """The k vectors with the smallest sha256 of `<salt>:<id>`, in that order (repeated ids: the smaller vector first); rows without an id never."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in rows.select(digest.alias("h"), "v").where("h IS NOT NULL").orderBy("h", "v").limit(k).collect()]


def _assigned(rows: DataFrame, dimension: int, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The state with dot products moved from the centroids `before` to `after`, the nearest centroid and its squared distance."""
    lengths = (after * after).sum(axis=1)
    changed = [np.flatnonzero(d) for d in after - before]

    def update(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dimension)
            dots = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, len(after)).copy()
            for c, at in enumerate(changed):
                if len(at):
                    dots[:, c] += v[:, at] @ (after - before)[c, at]
            distances = (v * v).sum(axis=1)[:, None] - 2 * dots + lengths
            cluster = distances.argmin(axis=1)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(after))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, pa.array(dots.ravel())), pa.array(cluster.astype(np.int32)), pa.array(distances[np.arange(n), cluster])],
                names=["id", "v", "dots", "cluster", "distance"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v", "dots").mapInArrow(update, f"id {kind}, v array<int>, dots array<bigint>, cluster int, distance bigint")


def _sums(state: DataFrame, dimension: int) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of each non-empty cluster; partial sums are made before the shuffle, so a large cluster needs no split."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dimension)]
    return {r[0]: (r[1], [int(x) for x in r[2:]]) for r in state.groupBy("cluster").agg(F.count("*"), *sums).collect()}


def cluster(rows: DataFrame, dimension: int, k: int = 8, rounds: int = 10) -> Clusters | None:
    """`rounds` rounds over (id, v) from the first centroids, and a last assignment; None without a vector that has an id.

    A vector goes to the nearest centroid (ties: the smaller number), a non-empty centroid becomes the componentwise floor(sum / count) of its vectors, an empty
    one stays. With fewer than k vectors there are as many centroids as vectors. Rounds end early once no centroid changes, which changes no result.
    """
    rows = cut_lineage(rows)
    start = first_centroids(rows, k)
    if not start:
        return None
    now = np.array(start, np.int64).reshape(len(start), dimension)
    zero = rows.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), len(start)))
    state = cut_lineage(_assigned(zero, dimension, np.zeros_like(now), now))
    discard(rows)
    for _ in range(rounds):
        after = now.copy()
        for c, (count, sums) in _sums(state, dimension).items():
            after[c] = [s // count for s in sums]
        if (after == now).all():
            break
        before = state
        state = cut_lineage(_assigned(before, dimension, now, after))
        discard(before)
        now = after
    return Clusters(state.select("id", "cluster", "distance"), now.tolist())


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dimension: int = 64, k: int = 8, rounds: int = 10) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that takes part.

    Null vectors, vectors of another length and those with a component that is null or not finite take no part. Repeated rows count as often as they
    occur. Rows without a key are assigned like others but never a first centroid. No such vectors: no rows. Components of more than
    16,384 in size raise an error, since distances are 64-bit integers.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    found = cluster(integers(vectors, key, vector, dimension), dimension, k, rounds)
    if found is None:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    totals = {r[0]: r[1] for r in found.vectors.groupBy("cluster").agg(F.sum("distance")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def of_cluster(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)

    return found.vectors.select(
        F.col("id").alias(key), "cluster", "distance",
        of_cluster([totals.get(c, 0) for c in range(len(digests))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(totals.values())).cast("long").alias("inertia"), of_cluster(digests).alias("centroid_sha256"),
    )
