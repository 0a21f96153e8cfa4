from __future__ import annotations

import hashlib
import math

import numpy as np

from trialweave.llm import centroids
from trialweave.llm.queries import QUERIES


def plain(rows, dimension, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]
    if not c:
        return []

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        of = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, at) in zip(kept, of) if at == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    of = assign()
    total = [sum(d for d, j in of if j == x) for x in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, j, d, total[j], sum(total), digest[j]) for (i, _), (d, j) in zip(kept, of)), key=str)


def found(frame):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in frame.collect()), key=str)


def test_against_the_plain_version(spark):
    draw = np.random.default_rng(2)
    v = draw.standard_normal((12, 6))[np.arange(400) % 12] + 0.3 * draw.standard_normal((400, 6))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for rounds in (0, 1, 10):
        assert found(centroids.cluster_vectors(frame, dimension=6, rounds=rounds)) == plain(rows, 6, rounds=rounds)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [2.0, -1.0]), (8, [1.0, 1.0, 1.0])]
    rows += [(i, [3.0, 3.0]) for i in range(100, 140)]
    frame = spark.createDataFrame([(*r, 1, 2, [3], 4) for r in rows], "vec_id long, embedding array<float>, cluster int, id int, v array<int>, dots int").repartition(3)
    for k in (1, 3, 8, 100):
        assert found(centroids.cluster_vectors(frame, dimension=2, k=k)) == plain(rows, 2, k)
    assert found(centroids.cluster_vectors(frame.where("vec_id IS NULL"), dimension=2)) == []
    assert found(centroids.cluster_vectors(frame.where("vec_id = -5"), dimension=2)) == []


def test_equal_vectors_leave_empty_centroids_where_they_are(spark):
    rows = [(i, [1.0, 1.0]) for i in range(20)] + [(99, [5.0, 5.0])]
    got = found(centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dimension=2))
    assert got == plain(rows, 2)


def test_the_query_against_the_plain_version(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert found(QUERIES["op13_centroid_clustering"](spark, sf)) == plain(rows, 64)
