from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import neighbours


def brute(rows, is_query, k):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in rows:
        if is_query(q):
            scores = sorted((-float((v * w).sum()), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in scores]
    return out


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_against_all_rows(spark, clustered):
    draw = np.random.default_rng(3)
    v = draw.standard_normal((3000, 32)) * draw.uniform(0.5, 2, (3000, 1))
    if clustered:
        v = draw.standard_normal((60, 32))[np.arange(3000) % 60] + 0.2 * draw.standard_normal((3000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(neighbours.search(frame, F.col("id") % 20 == 0, 20))
    want = brute(rows, lambda q: q % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    exact = {(q, i): float((v[q] * v[i]).sum()) for q in got for i, _ in got[q]}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in got for i, s in got[q])


def test_a_query_visits_few_cells_of_clustered_rows():
    draw = np.random.default_rng(5)
    v = draw.standard_normal((400, 32))[np.arange(20000) % 400] + 0.1 * draw.standard_normal((20000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    block = neighbours.Block(np.arange(50), v[:50], neighbours.Index(32, 1.0, 0.9))
    assert block.candidates(v).mean() < 0.2


def test_ties_copies_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.5, 0.5])]
    got = found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 20, 25))
    assert got == {20: [(i, 1.0) for i in range(26) if i != 20]}
    got = found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 20, 60))
    assert got == {20: [(i, 1.0) for i in range(30) if i != 20] + [(100, 0.5)]}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, id int")
    assert found(neighbours.search(frame, F.col("id") == 0, 20)) == {0: [(7, 4.0)]}
    assert neighbours.search(frame.where("vec_id > 90"), F.lit(True), 20).count() == 0
    assert neighbours.search(frame, F.col("id") == 8, 20).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    draw = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(draw.standard_normal((200, 8)))]
    got = found(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 5 == 0, 3, target=0.999))
    want = brute(rows, lambda q: q % 5 == 0, 3)
    assert sum([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want) >= 0.9 * len(want) == 36.0
