from __future__ import annotations

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trialweave.operators import encode, evaluate, explain, models, splits
from trialweave.plans.flagship import CATEGORICAL, NUMERIC, train_test

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    train, test = train_test(spark, SF)
    return train.persist(), test.persist()


def auc(scores):
    return evaluate.roc_auc(scores, []).first()[0]


def test_forest_is_good_and_repeats(data):
    """The floor was measured on the four text counts alone."""
    train, test = data
    pipeline = Pipeline(stages=[encode.preprocessor(NUMERIC, []), models.forest_classifier(30, seed=42)])
    first, second = (
        models.score_table(pipeline.fit(models.training_layout(df, "imageName")), test, ["imageName", "label"])
        for df in (train, train.repartition(3))
    )
    assert auc(first) >= 0.9
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_boosting_with_encoded_categories(data):
    train, test = data
    pipeline = models.target_encoded_boosting(NUMERIC, CATEGORICAL, maxIter=5, maxDepth=3, seed=1)
    assert auc(models.score_table(pipeline.fit(train), test, ["label"])) >= 0.8


def test_target_encoder_means(spark, data):
    train, _ = data
    fitted = models.target_encoded_boosting(NUMERIC, ["lang"], maxIter=1, maxDepth=1, smoothing=2.0).fit(train)
    shown = fitted.transform(train).groupBy("lang").agg(F.max("lang_mean").alias("m"), F.avg("label").alias("a"), F.count("*").alias("n"))
    overall = train.agg(F.avg("label")).first()[0]
    for r in shown.collect():
        assert r.m == pytest.approx((r.n * r.a + 2.0 * overall) / (r.n + 2.0))


def test_fourier_features_approximate_the_kernel(spark):
    rows = [(i, float(i % 3), float(i % 5) / 2) for i in range(12)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "id int, a double, b double")
    )
    out = models.FourierFeatures(size=4096, gamma=0.3).transform(df).collect()
    for p, q in itertools.combinations(out, 2):
        distance = (p.a - q.a) ** 2 + (p.b - q.b) ** 2
        assert float(p.fourier.dot(q.fourier)) == pytest.approx(math.exp(-0.3 * distance), abs=0.08)


def test_out_of_fold_scores_cover_each_row_once(data):
    train, _ = data
    folded = splits.stratified_folds(train, "label", "imageName", k=3).persist()
    pipeline = Pipeline(stages=[encode.preprocessor(NUMERIC, []), models.forest_classifier(5, seed=1)])
    scores = models.oof_predict(pipeline, folded, "fold", ["imageName"])
    ids = [r.imageName for r in scores.collect()]
    assert len(ids) == len(set(ids)) == train.count()


def test_best_grid_point_has_the_best_mean(data):
    train, _ = data
    folded = splits.stratified_folds(train, "label", "imageName", k=2).persist()
    points = models.grid_points({"numTrees": [1, 10], "maxDepth": [1, 4]})
    table, best = models.tune(
        encode.preprocessor(NUMERIC, []),
        lambda p: RandomForestClassifier(seed=1, **p),
        points,
        folded,
        "auc",
        "fold",
    )
    rows = table.collect()
    means = [np.mean([r.metric for r in rows if r.point == k]) for k in range(4)]
    assert len(rows) == 8 and points[int(np.argmax(means))] == best
    assert {r.point for r in rows if r.best} == {int(np.argmax(means))}


def test_attributions_add_up_and_match_brute_force():
    """One tree on two features with a repeated test, against the Shapley formula over all coalitions."""
    left, right = (False, (0.5,), True), (False, (0.5,), False)
    leaves = [
        explain.Leaf(1.0, [0], [0.4], [[left]]),
        explain.Leaf(3.0, [0, 1], [0.6, 0.25], [[right], [(True, (1.0, 2.0), True)]]),
        explain.Leaf(-2.0, [0, 1], [0.6, 0.75], [[right], [(True, (1.0, 2.0), False)]]),
    ]
    x = np.array([[0.2, 1.0], [0.9, 1.0], [0.9, 5.0]])

    def value(row, known):
        total = 0.0
        for leaf in leaves:
            passed = explain._passes(row[None, :], leaf)[0]
            total += leaf.value * np.prod([passed[k] if f in known else s for k, (f, s) in enumerate(zip(leaf.features, leaf.shares))])
        return total

    for row, found in zip(x, explain.attributions(x, leaves)):
        for f in (0, 1):
            other = 1 - f
            alone = value(row, {f}) - value(row, set())
            together = value(row, {f, other}) - value(row, {other})
            assert found[f] == pytest.approx((alone + together) / 2)
        assert found.sum() == pytest.approx(value(row, {0, 1}) - value(row, set()))


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_attributions_of_fitted_models_add_up(data, kind):
    train, test = data
    encoder = encode.preprocessor(NUMERIC, []).fit(train)
    estimator = models.boosted_classifier(rounds=3, depth=3) if kind == "boosted" else models.forest_classifier(5, maxDepth=4)
    model = estimator.fit(encoder.transform(train))
    scored = model.transform(encoder.transform(test))
    values = explain.shap_values(model, scored, NUMERIC, "imageName")
    sums = {r.imageName: r.s + r.b for r in values.groupBy("imageName").agg(
        F.sum("attribution").alias("s"), F.first("base").alias("b")).collect()}
    for r in scored.collect():
        target = r.rawPrediction[1] if kind == "boosted" else r.probability[1]
        assert sums[r.imageName] == pytest.approx(target, abs=1e-9)


def test_shadow_selection_rejects_noise(data):
    train, _ = data
    noise = F.conv(F.substring(F.md5("imageName"), 1, 6), 16, 10).cast("double")
    table = explain.shadow_select(train.withColumn("noise", noise), ["n_words", "noise"], "label", "imageName", rounds=6, trees=20)
    ranking = {r.feature: r.ranking for r in table.collect()}
    assert ranking["n_words"] == 1 and ranking["noise"] > 1


def test_weights_bound_the_ratio(spark):
    rows = [(1, "a")] * 10 + [(0, "a")] * 2 + [(1, "b")]
    train = spark.createDataFrame(rows, "y int, k string")
    val = spark.createDataFrame([(1, "a")] * 2 + [(0, "a")] * 3 + [(0, "c")], "y int, k string")
    weights = {(r.y, r.k): r.weight for r in splits.target_weights(train, val, ["y", "k"]).collect()}
    assert weights == {(1, "a"): 0.5, (0, "a"): 1.5, (1, "b"): 0.5, (0, "c"): 2.0}


def test_grids_have_the_sizes_of_the_inventory_and_build():
    sizes = {name: len(models.grid_points(grid)) for name, grid in models.GRIDS.items()}
    assert sizes == {"gbt": 36, "gbt_sampled": 18, "gbt_target_encoded": 18, "forest": 36, "svm": 24}
    for point in models.grid_points(models.GRIDS["forest"]):
        RandomForestClassifier(**models.with_depth(point))
    depths = {models.with_depth(p)["maxDepth"] for p in models.grid_points(models.GRIDS["gbt_sampled"])}
    assert depths == {3, 5, 6, 7}


def test_svm_grid_points_fit(data):
    train, _ = data
    folded = splits.stratified_folds(train, "label", "imageName", k=2).persist()
    points = models.grid_points({"C": [1], "gamma": [0.1], "kernel": ["rbf", "linear"]})
    build = lambda p: Pipeline(stages=models.svm_stages(140, iterations=5, size=32, **p))
    table, _ = models.tune(encode.preprocessor(NUMERIC, [], scale=True), build, points, folded, "accuracy", "fold")
    assert table.count() == 4 and table.agg(F.min("metric")).first()[0] > 0.5


def test_the_first_trees_are_the_model_of_so_many_rounds(spark):
    """One boosted fit answers every smaller number of rounds, in a pipeline too; a forest's first trees are a forest."""
    draw = np.random.default_rng(8)
    rows = [(i, int(a + b * b + draw.normal(0, 0.3) > 0.5), float(a), float(b)) for i, (a, b) in enumerate(draw.random((300, 2)))]
    frame = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "id int, label int, a double, b double").coalesce(1)).cache()
    whole = models.boosted_classifier(rounds=9, depth=3, rate=0.2).fit(frame)
    few = models.boosted_classifier(rounds=4, depth=3, rate=0.2).fit(frame)

    def scores(model):
        return [(r.id, r.prediction, r.prob) for r in models.score_table(model, frame, ["id"]).orderBy("id").collect()]

    assert scores(models.shortened(whole, 4)) == scores(few) != scores(whole)
    assert scores(models.shortened(whole, 9)) == scores(whole)
    forest = models.forest_classifier(6, seed=1, maxDepth=3).fit(frame)
    first = models.shortened(forest, 2)
    assert first.getNumTrees == len(first.trees) == 2 and [t.toDebugString for t in first.trees] == [t.toDebugString for t in forest.trees[:2]]
    assert len(scores(models.shortened(PipelineModel([forest]), 3))) == 300
    regressor = models.boosted_regressor(rounds=5, depth=2, label="a").fit(frame)
    assert len(models.shortened(regressor, 2).trees) == 2


def test_grids_need_fewer_fits_than_points():
    fits = {name: len(models._fits(models.grid_points(grid), models.with_depth if "maxDepth" in grid else dict)) for name, grid in models.GRIDS.items() if name != "svm"}
    assert fits == {"gbt": 12, "gbt_sampled": 8, "gbt_target_encoded": 6, "forest": 9}
    points = models.grid_points(models.GRIDS["gbt"])
    for most, answered in models._fits(points, dict):
        assert most["maxIter"] == 200 and sorted(t for _, t in answered) == [50, 100, 200]
        assert all({**points[n], "maxIter": 0} == {**most, "maxIter": 0} for n, _ in answered)


def test_shadow_selection_of_three_hundred_columns(spark):
    """Twenty columns that know the label are kept, no other one is, and the rounds end by themselves."""
    draw = np.random.default_rng(5)
    label = draw.integers(0, 2, 1500)
    table = draw.standard_normal((1500, 300))
    table[:, :20] += 1.5 * label[:, None]
    names = [f"c{i}" for i in range(300)]
    frame = spark.createDataFrame([(i, int(y), *map(float, x)) for i, (y, x) in enumerate(zip(label, table))], ["key", "label", *names])
    rows = {r.feature: r for r in explain.shadow_select(frame, names, "label", "key", trees=30, block_rows=400).collect()}
    assert {c for c, r in rows.items() if r.ranking == 1} == set(names[:20])
    assert max(r.rounds for r in rows.values()) < 60 and sum(r.ranking >= 3 for r in rows.values()) >= 270


def test_step_down_tests():
    assert explain.step_down({"a": 0.001, "b": 0.02, "c": 0.9}, 3, 0.05) == {"a", "b"}
    assert explain.step_down({"a": 0.02, "b": 0.001}, 10, 0.05) == {"b"}
    assert explain.step_down({}, 0, 0.05) == set()


def test_shadows_hold_the_values_of_their_columns(spark):
    rows = [(i, i % 2, float(i), None if i % 3 == 0 else float(-i)) for i in range(50)]
    blocks = explain.shuffle_blocks(spark.createDataFrame(rows, "key int, label int, a double, b double"), ["a", "b"], "label", "key", 1, block_rows=20)
    assert blocks.count() == 3
    got = [(r.label, *r.features.toArray().tolist()) for r in explain.with_shadows(blocks, [0, 1], 2, 7).collect()]
    mean = np.mean([-i for i in range(50) if i % 3])
    assert sorted(g[:3] for g in got) == sorted((y, a, mean if b is None else b) for _, y, a, b in rows)
    for column in (1, 2):
        assert sorted(g[column] for g in got) == sorted(g[column + 2] for g in got) and [g[column] for g in got] != [g[column + 2] for g in got]
    assert "SortMergeJoin" not in explain.with_shadows(blocks, [0, 1], 2, 7)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("leaves", [7, 100_000])
def test_attributions_of_deep_trees_in_blocks(spark, leaves):
    """A hundred trees of any depth, a leaf table in many blocks or in one: sums are those of the model, and the driver gets no leaf."""
    draw = np.random.default_rng(11)
    names = [f"f{i}" for i in range(12)]
    table = draw.integers(0, 50, (250, 12)).astype(float)
    rows = [(i, int(draw.random() < 0.5), *map(float, x)) for i, x in enumerate(table)]
    frame = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(rows, ["id", "label", *names]).coalesce(1)).cache()
    model = models.forest_classifier(100 if leaves > 7 else 8, seed=3).fit(frame)
    deepest = max(t.depth for t in model.trees)
    assert deepest >= 12
    blocks = explain.leaf_table(spark, model, leaves)
    assert blocks.count() > 20 if leaves == 7 else sum(len(json.loads(r.leaves)) for r in blocks.collect()) == sum((t.numNodes + 1) // 2 for t in model.trees)
    values = explain.shap_values(model, frame, names, "id", leaves)
    sums = {r.id: r.s + r.b for r in values.groupBy("id").agg(F.sum("attribution").alias("s"), F.first("base").alias("b")).collect()}
    scored = {r.id: r.probability[1] for r in model.transform(frame).select("id", "probability").collect()}
    assert sums == pytest.approx(scored, abs=1e-9) and values.count() == 250 * 12


def test_attributions_of_a_long_path_against_all_subsets():
    """Ten features on one path: the integral equals the sum over all coalitions."""
    draw = np.random.default_rng(2)
    d = 10
    leaf = explain.Leaf(2.5, list(range(d)), draw.uniform(0.1, 0.9, d).tolist(), [[(False, (0.5,), True)] for _ in range(d)])
    x = draw.random((1, d))
    passed = (x[0] <= 0.5).astype(float)
    for k in range(d):
        others = [i for i in range(d) if i != k]
        want = 0.0
        for n in range(d):
            for known in itertools.combinations(others, n):
                product = np.prod([passed[i] if i in known else leaf.shares[i] for i in others])
                want += math.factorial(n) * math.factorial(d - 1 - n) / math.factorial(d) * product
        assert explain.attributions(x, [leaf])[0, k] == pytest.approx(leaf.value * (passed[k] - leaf.shares[k]) * want)


def test_hadamard_product_is_the_explicit_one():
    matrix = np.array([[1.0]])
    for _ in range(4):
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    rows = np.random.default_rng(3).normal(size=(5, 16))
    assert np.allclose(models.hadamard(rows), rows @ matrix / 4)


@pytest.mark.parametrize("width", [3, 64, 100])
def test_kernel_error_of_the_features(spark, width):
    """Against the exact kernel, for widths below, at and beyond a block; the error falls with the number of features."""
    x = np.random.default_rng(width).normal(size=(40, width)) / math.sqrt(width)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, features array<double>").withColumn("features", array_to_vector("features"))
    exact = np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2))

    def error(size):
        out = models.FourierFeatures(size=size, gamma=0.7).transform(df).orderBy("i").collect()
        z = np.array([r.fourier.toArray() for r in out])
        assert z.shape == (40, size)
        return np.sqrt(((z @ z.T - exact) ** 2).mean())

    small, large = error(100), error(6400)
    assert large < 0.02 and large < small < 0.2


def test_svm_grid_shares_features_and_linear_points(spark):
    """Rows inside a circle are told from those outside by the rbf points only; linear points of all gammas are one fit."""
    random = np.random.default_rng(5)
    x = random.uniform(-1, 1, (300, 2))
    rows = [(v.tolist(), float((v**2).sum() < 0.5), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "features array<double>, label double, fold int").coalesce(1).withColumn("features", array_to_vector("features"))
    points = models.grid_points({"C": [1, 10], "gamma": [1, 0.1], "kernel": ["rbf", "linear"]})
    grid = models.svm_grid(points, size=128, iterations=15)
    assert len(models._fits(points, grid["same"])) == 6
    table, best = models.tune(None, df=df, metric="accuracy", fold_col="fold", **grid)
    rows = table.collect()
    assert len(rows) == 16 and best["kernel"] == "rbf"
    metric = {(r.point, r.fold): r.metric for r in rows}
    linear = [i for i, p in enumerate(points) if p["kernel"] == "linear"]
    for c in (1, 10):
        twins = [i for i in linear if points[i]["C"] == c]
        assert all(metric[twins[0], f] == metric[twins[1], f] for f in range(2))
    train, held_out = df.where("fold <> 0"), df.where("fold = 0")
    alone = Pipeline(stages=models.svm_stages(train.count(), "rbf", best["C"], best["gamma"], size=128, iterations=15)).fit(train)
    separate = models.evaluator("accuracy").evaluate(alone.transform(held_out))
    assert metric[points.index(best), 0] == pytest.approx(separate, abs=1e-12)


@pytest.mark.parametrize("kind", ["forest_classifier", "forest_regressor"])
def test_a_forest_in_parts_is_the_mean_of_all_its_trees(spark, monkeypatch, kind):
    """The driver has few trees at once, and no tree is left out or counted twice; a forest that fits is the plain one."""
    rows = [(Vectors.dense(float(i % 13), float(i % 7)), float((i * 7 % 11) > 5)) for i in range(60)]
    frame = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    forest = getattr(models, kind)(7, seed=5, **({"label": "label"} if kind == "forest_regressor" else {}))
    plain = models.InParts(forest).fit(frame)
    assert type(plain).__name__.startswith("RandomForest") and plain.getNumTrees == 7
    monkeypatch.setattr(models, "NODES", 240)
    parts = models.InParts(forest).fit(frame)
    assert len(parts.parts) > 1 and sum(trees for _, _, trees in parts.parts) == 7 and parts.parts[0][2] == 3
    trees = [t for c, path, _ in parts.parts for t in c.load(path).trees]
    assert len(trees) == 7
    for row in parts.transform(frame).collect():
        if kind == "forest_regressor":
            assert row.prediction == pytest.approx(sum(t.predict(row.features) for t in trees) / 7)
        else:
            votes = sum(t.predictProbability(row.features).toArray() for t in trees) / 7
            assert row.probability.toArray() == pytest.approx(votes) and (abs(votes[0] - votes[1]) < 1e-9 or row.prediction == votes.argmax())


def test_importances_of_a_forest_in_parts_are_those_of_all_its_trees(spark, monkeypatch):
    """Feature ranking fits its forest in parts as well; a tree without a split counts nowhere."""
    rows = [(str(i), float(i % 13), float(i % 7), int((i * 7 % 11) > 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, a double, b double, label int")
    fitted = []
    fit = models.InParts._fit
    monkeypatch.setattr(models, "NODES", 240)
    monkeypatch.setattr(models.InParts, "_fit", lambda self, frame: fitted.append(fit(self, frame)) or fitted[-1])
    ranked = {r.feature: r.importance for r in explain.rank_features(df, ["a", "b"], "label", "key", trees=7).collect()}
    (parts,) = fitted
    assert len(parts.parts) > 1
    trees = [t.featureImportances.toArray() for kind, path, _ in parts.parts for t in kind.load(path).trees]
    total = sum(trees)
    assert len(trees) == 7 and [ranked["a"], ranked["b"]] == pytest.approx((total / total.sum()).tolist())
