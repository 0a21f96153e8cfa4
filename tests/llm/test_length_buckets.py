from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import length_buckets


def plain(rows, is_query, k):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in rows:
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return {q: x for q, x in out.items() if x}


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("kind", ["random", "clustered", "lengths"])
def test_against_all_pairs(spark, kind):
    draw = np.random.default_rng(3)
    v = draw.standard_normal((1500, 16))
    if kind == "clustered":
        v = draw.standard_normal((40, 16))[np.arange(1500) % 40] + 0.05 * draw.standard_normal((1500, 16))
        v /= np.linalg.norm(v, axis=1)[:, None]
    if kind == "lengths":
        v *= np.exp(draw.standard_normal((1500, 1)) * 1.5)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(length_buckets.search(frame, F.col("id") % 20 == 0, 10, bucket_cells=1600, block_cells=160))
    assert got == plain(rows, lambda q: q % 20 == 0, 10)


def test_ties_copies_zeros_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.5, 0.5]), (101, [0.0, 0.0]), (102, [-1.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (3, 25, 60):
        for cells in (4, 1 << 18):
            got = found(length_buckets.search(frame, F.col("id") >= 20, k, bucket_cells=cells, block_cells=8))
            assert got == plain(rows, lambda q: q >= 20, k)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [])]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, rank int, id int, n int")
    assert found(length_buckets.search(frame, F.lit(True), 20)) == plain([r for r in rows if r != rows[0]] + [rows[0]], lambda q: q not in (7, 3), 20) | {
        7: [(0, 4 << 20), (0, 4 << 20), (3, 0)], 3: [(0, 0), (0, 0), (7, 0)]
    }
    assert length_buckets.search(frame.where("vec_id > 90"), F.lit(True), 20).count() == 0
    assert length_buckets.search(frame, F.lit(False), 20).count() == 0


def test_exact_beyond_floats(spark):
    big = float(1 << 20)
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [big, 1 / 1024]), (3, [big, -1 / 1024])]
    got = found(length_buckets.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, 3))
    assert got == plain(rows, lambda q: q == 0, 3) and [i for i, _ in got[0]] == [2, 1, 3]


def test_prunings_leave_less_and_lose_nothing():
    """Short buckets are not entered, and close neighbours are looked up by coordinate."""
    draw = np.random.default_rng(7)
    v = draw.standard_normal((50, 8))[np.arange(2000) % 50] + 0.005 * draw.standard_normal((2000, 8))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    bucket = length_buckets.Bucket(np.arange(2000), v)
    query = v[0]
    scores = v @ query
    theta = np.sort(scores)[-20]
    rows, count = bucket.feasible(query / np.linalg.norm(query), theta / (np.linalg.norm(query) * bucket.lengths[0]))
    assert rows is not None and len(rows) <= count < 2000 * length_buckets.COORDINATE_SHARE
    assert set(np.flatnonzero(scores >= theta)) <= set(bucket.ids[rows])
    q, of, score = bucket.search(np.array([0]), query[None], np.array([10 * theta]), np.array([True]), 5)
    assert not len(q) and not len(of) and not len(score)


def test_blocks_that_cannot_reach_are_not_joined(spark):
    draw = np.random.default_rng(9)
    v = draw.standard_normal((600, 8)) * np.where(np.arange(600) < 100, 10, 0.01)[:, None]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = length_buckets.integers(frame, "vec_id", "embedding").orderBy(F.desc("squared")).coalesce(1)
    packed = length_buckets._numbered(length_buckets._packed(rows, 800), "bucket")
    about = [(r.bucket, r.n, r.longest) for r in packed.collect()]
    first = max(packed.collect(), key=lambda r: r.longest)
    asked = length_buckets._numbered(length_buckets._packed(rows.where("id % 20 = 0 AND id < 100"), 80), "block")
    aimed = length_buckets._aimed(asked, about, {8: (bytes(first.ids), bytes(first.matrix))}, 5).collect()
    assert len(about) == 6 and all(len(r.buckets) == 1 for r in aimed)


def test_blocks_that_go_to_many_buckets_are_not_broadcast(spark):
    """A block of queries is repeated for each bucket that it goes to, which the planner does not weigh."""
    draw = np.random.default_rng(9)
    rows = [(i, x.tolist()) for i, x in enumerate(draw.standard_normal((300, 8)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = length_buckets.search(frame, F.col("id") % 10 == 0, 5, bucket_cells=64, block_cells=64)
    assert found(got) == plain(rows, lambda i: i % 10 == 0, 5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
