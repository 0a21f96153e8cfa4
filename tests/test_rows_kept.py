"""Rows in are rows out, or a quarantine row with a reason."""

from __future__ import annotations

import os

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from trialweave.functions import transforms as tr
from trialweave.imaging import filters as fl, prepare as pr
from trialweave.operators import encode, evaluate, explain, models, ranking, splits
from trialweave.operators.relational import lookup
from trialweave.session import cut_lineage, discard


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(100).select(F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("key"), (F.col("id") % 2).cast("int").alias("label"))


def test_null_keys_have_a_position_a_side_and_a_fold(keyed):
    assert ranking.hash_positions(keyed, [], "key", 1, "p").agg(F.count_distinct("p")).first()[0] == 100
    train, test = splits.split_random(keyed, "key", 0.3)
    assert train.count() + test.count() == 100
    assert splits.stratified_folds(keyed, "label", "key").count() == 100
    assert splits.stratified_folds(keyed, "label", "key", seed=None).count() == 100


def test_rows_with_a_null_feature_are_ranked(spark, monkeypatch):
    rows = [(str(i), i % 2, float(i % 2) if i % 4 else None, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, label int, a double, b double")
    seen = []
    real = explain.training_layout
    monkeypatch.setattr(explain, "training_layout", lambda x, key: seen.append(x.count()) or real(x, key))
    ranked = explain.rank_features(df, ["a", "b"], "label", "key", trees=5)
    assert seen == [40] and {r.feature for r in ranked.collect()} == {"a", "b"}
    kept = explain.select_features_by(df, ranked, 2, ["key"])
    assert len(kept.columns) == 2 and kept.count() == 40


def test_rejected_features_have_ranks_of_their_own(spark):
    rows = [(str(i), i % 2, i % 2 + i / 1000, float(i * 7919 % 101), float(i * 104729 % 97)) for i in range(120)]
    df = spark.createDataFrame(rows, "key string, label int, good double, n1 double, n2 double")
    got = {r.feature: r.ranking for r in explain.shadow_select(df, ["good", "n1", "n2"], "label", "key", rounds=7, trees=10).collect()}
    assert got["good"] == 1 and all(got[c] >= 2 for c in ("n1", "n2"))
    assert got["n1"] != got["n2"] or got["n1"] == 2


def test_null_scores_are_no_threshold_and_null_groups_keep_their_curve(spark):
    rows = [("a", 0.9, 1), ("a", 0.1, 0), ("a", None, 1), (None, 0.8, 1), (None, 0.2, 0), (None, 0.3, None)]
    df = spark.createDataFrame(rows, "model string, prob double, label int")
    curve = {}
    for r in evaluate.roc_curve(df, ["model"]).collect():
        curve.setdefault(r.model, []).append((r.threshold, r.fpr, r.tpr))
    assert sorted(curve["a"], key=str) == sorted([(None, 0.0, 0.0), (0.9, 0.0, 1.0), (0.1, 1.0, 1.0)], key=str)
    assert len(curve[None]) == 3 and (0.2, 1.0, 1.0) in curve[None]
    assert {r.model: r.auc for r in evaluate.roc_auc(df, ["model"]).collect()} == {"a": 1.0, None: 1.0}


def test_numbers_stay_numbers_and_many_categories_fit(spark):
    rows = [(float(i % 5), f"c{i // 5:02d}", int(i % 5 > 2)) for i in range(200)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "n double, c string, label int")
    model = models.sampled_boosting(["n"], ["c"], maxIter=2, maxDepth=3, seed=1).fit(df)
    unseen = spark.createDataFrame([(3.5, "c00", 1), (99.0, "other", 1), (0.5, "c01", 0)], "n double, c string, label int")
    assert [r.prediction for r in models.score_table(model, unseen, ["n"]).orderBy("n").collect()] == [0, 1, 1]  # by the number
    encoded = models.target_encoded_boosting(["n"], ["c"], maxIter=2, seed=1).fit(df)
    assert models.score_table(encoded, df, ["n"]).count() == 201


def test_class_weight_without_positives(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert [r.class_weight for r in models.with_class_weight(df).collect()] == [1.0, 1.0]


def test_an_overflowing_voxel_is_null(spark):
    df = spark.createDataFrame([(30000, 1.5, 0.0), (100, 1.5, -24.0)], "v int, s double, i double")
    assert [r[0] for r in df.select(tr.hounsfield(F.col("v"), F.col("s"), F.col("i"))).collect()] == [None, 126]


def volume(name, voxels):
    return [(name, z, y, x, float(v), 1) for (z, y, x), v in voxels.items()]


def test_images_that_cannot_be_worked_on_are_reported(spark):
    full = {(z, y, x): z + y + x for z in range(2) for y in range(2) for x in range(2)}
    gap = {p: v for p, v in full.items() if p != (0, 0, 1)}
    rows = volume("good", full) + volume("gap", gap) + volume("flat", full) + volume("unplanned", full)
    voxels = spark.createDataFrame(rows, "image_name string, z int, y int, x int, value double, mask int")
    plan = spark.createDataFrame([("good", 2, 2, 2), ("gap", 2, 2, 2), ("flat", None, 2, 0)], "image_name string, new_n_z int, new_n_y int, new_n_x int")
    good, bad = pr.quarantine(voxels, voxels.drop("value"), plan)
    assert {r.image_name: r.reason for r in bad.collect()} == {"gap": "gap", "flat": "no grid", "unplanned": "no grid"}
    assert pr.resample_volume(good.select("image_name", "z", "y", "x", "value", "mask"), plan).count() == 8


def test_filtered_voxels_keep_their_coordinates(spark):
    rows = [("a", 0, 0, x, 1.0, 1) for x in (0, 1, 2, 5, 6, 7)]
    df = spark.createDataFrame(rows, "image_name string, z int, y int, x int, value double, mask int")
    assert sorted(r.x for r in fl.filter_log(df, ["image_name"], 1.0).collect()) == [0, 1, 2, 5, 6, 7]


def test_filters_against_plain_convolution(spark):
    import numpy as np

    values = np.random.default_rng(1).normal(size=(4, 4, 4))
    rows = [("a", z, y, x, float(values[z, y, x]), 1) for z in range(4) for y in range(4) for x in range(4)]
    df = spark.createDataFrame(rows, "image_name string, z int, y int, x int, value double, mask int")
    got = {(r["filter"], r.z, r.y, r.x): r.value for r in fl.filter_wavelet(df, ["image_name"], 1).collect()}
    taps = {"L": fl.COIF1_LOW[::-1], "H": fl.COIF1_HIGH[::-1]}
    first = len(fl.COIF1_LOW) // 2 - (len(fl.COIF1_LOW) - 1)
    for band in ("LHH", "HLL"):
        out = values
        for axis, letter in zip((2, 1, 0), band):
            out = sum(t * np.roll(out, -(first + k), axis=axis) for k, t in enumerate(taps[letter]))
        assert all(abs(got[f"wavelet-{band}", z, y, x] - out[z, y, x]) < 1e-9 for z in range(4) for y in range(4) for x in range(4))


def test_a_small_key_table_does_not_shuffle_the_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 12).alias("k"))
    table = spark.range(10).select(F.col("id").alias("k"), F.lit(2.0).alias("w"))
    joined = lookup(rows, table, ["k"], "w", F.lit(1.0))
    assert "SortMergeJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.agg(F.sum("w")).first()[0] == 1000 + joined.where("k < 10").count()


def test_codes_are_written_when_they_are_fitted(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = encode.CategoryCodes(["c"]).fit(df)
    assert "parquet" in codes.tables["c"]._jdf.queryExecution().executedPlan().toString().lower()
    assert [r.c for r in codes.transform(df).collect()].count(-1) == 1


def test_parallel_folds_give_the_same_scores(spark):
    rows = [(str(i), i % 2, i % 2 + i / 100, i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, label int, a double, fold int")
    pipeline = Pipeline(stages=[encode.preprocessor(["a"], []), models.forest_classifier(3, seed=1)])
    one, many = (sorted(map(tuple, models.oof_predict(pipeline, df, "fold", ["key"], n).collect())) for n in (1, 3))
    assert one == many and len(one) == 60


def test_a_discarded_stage_is_gone(spark):
    stage = cut_lineage(spark.range(3))
    folder = stage.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    discard(stage)
    assert not os.path.exists(folder)
    with pytest.raises(ValueError):
        discard(spark.range(3))


@pytest.mark.parametrize("heavy", [0, 5, 1000])
def test_codes_do_not_depend_on_what_is_broadcast(spark, monkeypatch, heavy):
    """Half of the rows share a value and some have none; a long value is never broadcast; unseen values are -1."""
    monkeypatch.setattr(encode, "HEAVY", heavy)
    value = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 11 == 0, None).when(F.col("id") == 7, F.repeat(F.lit("x"), 400)).otherwise((F.col("id") % 40).cast("string"))
    df = spark.range(600).withColumn("c", value)
    codes = encode.CategoryCodes(["c"]).fit(df)
    assert (codes.rest["c"] is None) == (codes.heavy["c"].count() == df.select("c").dropna().distinct().count())
    assert codes.heavy["c"].where(F.length("c") > 256).isEmpty()
    values = sorted({r.c for r in df.collect()} - {None})
    wanted = {v: i for i, v in enumerate(values)} | {None: -1}
    found = codes.transform(df).collect()
    given = {r.id: r.c for r in df.collect()}
    assert len(found) == 600 and all(r.c == wanted[given[r.id]] for r in found)
    other = spark.createDataFrame([("hot",), ("never seen",), (None,)], "c string")
    assert sorted(r.c for r in codes.transform(other).collect()) == [-1, -1, values.index("hot")]


def test_a_small_vocabulary_needs_no_shuffle(spark):
    df = spark.range(100).withColumn("c", (F.col("id") % 7).cast("string"))
    plan = encode.CategoryCodes(["c"]).fit(df).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
