from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from trialweave.operators import evaluate, ranking, splits


def skewed(spark, rows=3000):
    """One group holds two thirds of the rows, and order values repeat."""
    return spark.range(rows).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("g"),
        (F.col("id") * 37 % 211).cast("double").alias("v"),
    )


@pytest.mark.parametrize("cuts", [[], [(50.0, 0)], None])
def test_positions_do_not_depend_on_the_cuts(spark, cuts):
    rows = ranking.positions(skewed(spark), ["g"], ["v", "id"], "p", cuts=cuts).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append((r.v, r.id, r.p))
    for members in groups.values():
        assert [p for _, _, p in sorted(members)] == list(range(len(members)))


def test_positions_spread_rows_without_an_order_value(spark):
    """Nulls sort first and are still cut by the next column."""
    df = skewed(spark).withColumn("v", F.when(F.col("id") % 4 == 0, F.col("v")))
    cuts = ranking.order_cuts(df, ["v", "id"], buckets=8)
    assert any(v is None for v, _ in cuts)
    rows = ranking.positions(df, [], ["v", "id"], "p", cuts=cuts).collect()
    ordered = sorted(rows, key=lambda r: (r.v is not None, r.v or 0.0, r.id))
    assert [r.p for r in ordered] == list(range(len(rows)))


@pytest.mark.parametrize("order", [["v"], ["w"], ["v", "id"], ["t"]])
def test_the_number_of_buckets_follows_the_rows(spark, monkeypatch, order):
    """More cuts than are written out as conditions; positions stay exact and buckets stay small."""
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 5)
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3001).cast("double").alias("v"), (F.col("id") * 7919 % 3001).alias("w"))
    df = df.withColumn("t", F.lpad(F.col("w").cast("string"), 5, "0"))
    cuts = ranking.order_cuts(df, order)
    assert ranking.WRITTEN_CUTS < len(cuts) < 600
    largest = df.groupBy(ranking._bucket(df, order, cuts).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest <= 50
    rows = ranking.positions(df, [], order, "p").collect()
    assert [r.p for r in sorted(rows, key=lambda r: r.w)] == list(range(3000))


def test_a_sketched_order_with_nulls_nans_and_no_rows(spark):
    values = [None, None, float("nan"), float("inf"), float("-inf")] + [float(i % 50) for i in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, id long")
    cuts = ranking.order_cuts(df, ["v"], buckets=16)
    assert cuts == sorted(cuts) and all(v == v and v is not None for (v,) in cuts)
    rows = sorted(ranking.positions(df, [], ["v"], "p").collect(), key=lambda r: r.p)
    assert [r.p for r in rows] == list(range(len(values)))
    plain = [r.v for r in rows]
    assert plain[:2] == [None, None] and plain[2] == float("-inf") and plain[-2] == float("inf") and plain[-1] != plain[-1]
    for frame in (df.limit(0), df.where("v IS NULL")):
        assert ranking.order_cuts(frame, ["v"]) == []
    assert ranking.order_cuts(df.limit(0), ["v", "id"]) == []


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_running_sums_and_auc_hold_under_any_layout(spark, partitions):
    df = skewed(spark).repartition(partitions).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    auc = {r.g: r.auc for r in evaluate.roc_auc(df, ["g"], "v").collect()}
    rows = df.collect()
    for group, value in auc.items():
        pos = [r.v for r in rows if r.g == group and r.label == 1]
        neg = [r.v for r in rows if r.g == group and r.label == 0]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert math.isclose(value, wins / len(pos) / len(neg), rel_tol=1e-12)


def test_auc_under_monotone_change_and_negation(spark):
    df = skewed(spark).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    plain, cubed, negated = (
        evaluate.roc_auc(df.withColumn("s", s), [], "s").first()[0]
        for s in (F.col("v"), F.pow("v", F.lit(3.0)), -F.col("v"))
    )
    assert math.isclose(plain, cubed, rel_tol=1e-12) and math.isclose(plain, 1 - negated, rel_tol=1e-12)


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("fraction", [0.0, 0.001, 0.3, 1.0])
def test_random_split_has_the_exact_size_and_hash_order(spark, fraction, digits, monkeypatch):
    rows = skewed(spark, 1001)
    n = math.ceil(fraction * 1001)
    cut = ranking.smallest_hashes(rows, "id", 21, n, digits)
    hashes = sorted(hashlib.md5(f"21:{i}".encode()).hexdigest() for i in range(1001))
    assert sum(h <= cut for h in hashes) == n if cut else n == 0
    train, test = splits.split_random(rows, "id", fraction, 21)
    assert (train.count(), test.count()) == (1001 - n, n)


def test_folds_are_balanced_disjoint_and_repeatable(spark):
    df = skewed(spark).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    folded = splits.stratified_folds(df, "label", "id", k=5, seed=42)
    counts = folded.groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in counts if r.label == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    again = splits.stratified_folds(df.repartition(7), "label", "id", k=5, seed=42)
    key = lambda r: (r.id, r.fold)
    assert sorted(map(key, folded.collect())) == sorted(map(key, again.collect()))


def test_roc_curve_is_monotone_and_ends_at_one(spark):
    df = skewed(spark).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    points = sorted((r.fpr, r.tpr) for r in evaluate.roc_curve(df, [], "v").collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(points, points[1:]))
