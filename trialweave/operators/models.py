"""Training, tuning and out-of-fold scoring with Spark ML.

Estimators take the vector column "features" and the label column "label". Models see their rows in one fixed
layout (training_layout), because tree ensembles depend on how the rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, TargetEncoder, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.operators.encode import fill_text, mean_filled, preprocessor
from trialweave.operators.evaluate import accuracy_at, log_loss, roc_auc
from trialweave.session import cut_lineage, discard, scratch_path

# Values of the five grids, parameter name -> values; None is "no limit". Fixed values.
GRIDS = {
    "gbt": {"maxIter": [50, 100, 200], "maxDepth": [2, 3, 4, 5], "stepSize": [0.01, 0.05, 0.1]},
    "gbt_sampled": {"stepSize": [0.001], "leaves": [31, 63, 127], "maxDepth": [None, 3, 5], "subsamplingRate": [0.8, 1.0]},
    "gbt_target_encoded": {"maxIter": [30, 50, 100], "stepSize": [0.005, 0.01, 0.05], "maxDepth": [3, 6]},
    "forest": {"numTrees": [100, 200, 300], "maxDepth": [None, 10, 20, 30], "minInstancesPerNode": [1, 2, 4]},
    "svm": {"C": [0.1, 1, 10], "gamma": [1, 0.1, 0.01, 0.001], "kernel": ["rbf", "linear"]},
}

# The deepest tree that Spark ML grows.
MAX_DEPTH = 30


def with_depth(point: dict) -> dict:
    """A grid point in Spark's terms: no depth limit is the deepest tree, a leaf cap the depth of as many leaves."""
    changed = dict(point)
    leaves = changed.pop("leaves", None)
    caps = [MAX_DEPTH if changed.get("maxDepth") is None else changed["maxDepth"]]
    if leaves is not None:
        caps.append(math.ceil(math.log2(leaves)))
    return changed | {"maxDepth": min(caps)}


#: Partitions of the rows that a forest or a network is fitted on, and the fewest rows of one.
SPREAD, LEAST_ROWS = 16, 1_000


def training_layout(df: DataFrame, key: str, rows_per_partition: int = 100_000, spread: int = 1) -> DataFrame:
    """Rows hashed by key into as many partitions as their count asks for, and sorted, so that a seed repeats.

    Training runs many short jobs over the same rows, so small tables belong in few partitions. Where a row is much work (a forest's trees, a
    network's layers), `spread` is how many partitions even a table of few rows should have.
    """
    rows = df.count()
    n = max(1, math.ceil(rows / rows_per_partition), min(spread, math.ceil(rows / LEAST_ROWS)))
    return df.repartition(n, key).sortWithinPartitions(key)


def forest_classifier(trees: int = 100, seed: int = 42, **params) -> RandomForestClassifier:
    """Without a depth the trees have no limit but the library's. Rows remember their nodes, so that the forest is not sent out at each step."""
    return RandomForestClassifier(numTrees=trees, impurity="gini", seed=seed, **({"maxDepth": MAX_DEPTH, "cacheNodeIds": True} | params))


def forest_regressor(trees: int = 100, seed: int = 42, label: str = "y", **params) -> RandomForestRegressor:
    return RandomForestRegressor(numTrees=trees, seed=seed, labelCol=label, **({"maxDepth": MAX_DEPTH, "cacheNodeIds": True} | params))


def boosted_classifier(rounds: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 42, **params) -> GBTClassifier:
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **params)


def boosted_regressor(
    rounds: int = 100, depth: int = 6, rate: float = 0.3, seed: int = 42, label: str = "y", **params
) -> GBTRegressor:
    return GBTRegressor(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, labelCol=label, **params)


#: Nodes of trees that the driver keeps at once: more than a kilobyte each while they grow.
NODES = 250_000


class InParts(Estimator):
    """A forest whose trees are fitted some at a time, so that the driver has the nodes of a few trees and not of all.

    A tree has fewer than two nodes for each row that its sample holds (about 0.63 of all), which gives the first part; the others are as large as the trees before allow, one tree at least. Each part has a
    seed of its own and is written to the shared folder. Where all trees fit at once, the fitted model is the plain one of Spark ML.
    """

    def __init__(self, forest: Estimator):
        super().__init__()
        self.forest = forest

    def _fit(self, df: DataFrame) -> Transformer:
        forest, trees = self.forest, self.forest.getNumTrees()
        size = int(NODES / (2 * (1 - math.exp(-1)) * max(1, df.count())))
        if size >= trees:
            return forest.fit(df)
        done, parts, largest, importances = 0, [], 0.0, 0.0
        while done < trees:
            size = min(max(1, size), trees - done)
            model = forest.copy({forest.numTrees: size, forest.seed: forest.getSeed() + done}).fit(df)
            path = scratch_path(df.sparkSession, "forest")
            model.write().save(path)
            parts.append((type(model), path, size))
            # A part's importances are the mean over its trees with a split.
            importances = importances + model.featureImportances.toArray() * sum(t.numNodes > 1 for t in model.trees)
            largest = max(largest, model.totalNumNodes / size)
            done, size = done + size, int(NODES / largest)
            del model  # the driver would keep it while the next part grows
        return Parts(parts, importances)


class Parts(Transformer):
    """The forest of several fitted ones: the mean over all trees, which is what one forest of them predicts. Parts are read one at a time, and the rows
    are written behind each."""

    def __init__(self, parts: list[tuple[type, str, int]], importances: np.ndarray):
        super().__init__()
        self.parts, self.importances = parts, importances

    @property
    def featureImportances(self) -> DenseVector:
        """The mean over all trees with a split, which is what one forest of them has."""
        return DenseVector(self.importances / (self.importances.sum() or 1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        total, before = sum(trees for _, _, trees in self.parts), None
        scored = df
        for kind, path, trees in self.parts:
            model = kind.load(path)
            classes = kind is RandomForestClassificationModel
            votes = F.transform(vector_to_array(model.getProbabilityCol()), lambda p: p * trees) if classes else F.array(F.col(model.getPredictionCol()) * trees)
            summed = votes if before is None else F.zip_with("forest_votes", votes, lambda a, b: a + b)
            scored = cut_lineage(model.transform(scored).select(*df.columns, summed.alias("forest_votes")))
            if before is not None:
                discard(before)
            before = scored
        means = F.transform("forest_votes", lambda v: v / total)
        if not classes:
            return scored.withColumn(model.getPredictionCol(), means[0]).drop("forest_votes")
        best = (F.array_position("forest_votes", F.array_max("forest_votes")) - 1).cast("double")
        return scored.withColumn(model.getProbabilityCol(), array_to_vector(means)).withColumn(model.getPredictionCol(), best).drop("forest_votes")


class WideEnough(Estimator):
    """A tree estimator whose maxBins is raised to the most categories of any feature of the rows it is fitted on."""

    def __init__(self, trees: Estimator):
        super().__init__()
        self.trees = trees

    def _fit(self, df: DataFrame) -> Transformer:
        nominal = df.schema[self.trees.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
        widest = max([self.trees.getMaxBins(), *(a.get("num_vals", len(a.get("vals", []))) for a in nominal)])
        return self.trees.copy({self.trees.maxBins: widest}).fit(df)


def sampled_boosting(
    numeric: list[str], categorical: list[str], **params
) -> Pipeline:
    """Boosted trees on row samples; categories enter as codes that the trees split as categories, numbers stay numbers.

    Trees grow by depth; a leaf cap is the depth of as many leaves. Null numbers count as the mean of the training rows.
    """
    texts = [f"{c}_text" for c in categorical]
    codes = [f"{c}_code" for c in texts]
    stages = [
        *mean_filled(numeric),
        fill_text(categorical),
        StringIndexer(inputCols=texts, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=[*[f"{c}_value" for c in numeric], *codes], outputCol="features"),
        WideEnough(GBTClassifier(**params)),
    ]
    return Pipeline(stages=stages)


def target_encoded_boosting(
    numeric: list[str], categorical: list[str], label: str = "label", smoothing: float = 1.0, **params
) -> Pipeline:
    """Boosted trees on smoothed label means per category, learned by the pipeline from its training rows, as are the means of null numbers."""
    texts = [f"{c}_text" for c in categorical]
    codes = [f"{c}_code" for c in texts]
    means = [f"{c}_mean" for c in categorical]
    stages = [
        *mean_filled(numeric),
        fill_text(categorical),
        StringIndexer(inputCols=texts, outputCols=codes, stringOrderType="alphabetAsc", handleInvalid="keep"),
        TargetEncoder(
            inputCols=codes, outputCols=means, labelCol=label, targetType="binary", smoothing=smoothing, handleInvalid="keep"
        ),
        VectorAssembler(inputCols=[*[f"{c}_value" for c in numeric], *means], outputCol="features"),
        GBTClassifier(labelCol=label, **params),
    ]
    return Pipeline(stages=stages)


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Rows times the orthonormal Walsh-Hadamard matrix in d log d steps; their width d is a power of two."""
    width, half = rows.shape[1], 1
    while half < width:
        pairs = rows.reshape(len(rows), -1, 2, half)
        rows = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(rows), width)
        half *= 2
    return rows / math.sqrt(width)


#: Least width of the blocks of directions, so that their entries are close to normal for vectors of few columns, and values projected at once.
BLOCK_WIDTH, BLOCK_VALUES = 64, 1 << 21


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose inner products approximate the kernel exp(-gamma |x - y|^2).

    Directions come in orthogonal blocks as wide as the vectors: three rounds of random signs and a Hadamard product, so that a row of d columns costs
    log d for a feature instead of d and only signs are kept.
    """

    inputCol = Param(Params._dummy(), "inputCol", "vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="fourier", size=256, gamma=0.1, seed=42):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="features", outputCol="fourier", size=256, gamma=0.1, seed=42)

    def _transform(self, df: DataFrame) -> DataFrame:
        size, gamma, seed = (self.getOrDefault(p) for p in ("size", "gamma", "seed"))

        def features(x: np.ndarray) -> np.ndarray:
            width = max(BLOCK_WIDTH, 1 << (x.shape[1] - 1).bit_length())
            random = np.random.default_rng(seed)
            shifts = random.uniform(0, 2 * math.pi, size)
            padded = np.pad(x, ((0, 0), (0, width - x.shape[1])))
            blocks = []
            for _ in range(math.ceil(size / width)):
                turned = padded
                for signs in random.choice([-1.0, 1.0], (3, width)):
                    turned = hadamard(turned * signs)
                blocks.append(turned)
            angles = math.sqrt(2 * gamma * width) * np.hstack(blocks)[:, :size] + shifts
            return math.sqrt(2 / size) * np.cos(angles)

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                step = max(1, BLOCK_VALUES // size)
                out = [row for i in range(0, len(vectors), step) for row in features(np.stack(vectors.iloc[i : i + step].to_numpy()))]
                yield pd.Series(out, dtype=object)

        projected = project(vector_to_array(self.getOrDefault("inputCol")))
        return df.withColumn(self.getOrDefault("outputCol"), array_to_vector(projected))


def svm_stages(
    rows: int, kernel: str, C: float, gamma: float, size: int = 256, iterations: int = 100, prediction: str = "prediction"
) -> list:
    """Linear SVM with the regularisation that a penalty C means for this many rows; rbf adds Fourier features."""
    mapped = [FourierFeatures(inputCol="features", outputCol="fourier", gamma=gamma, size=size)] if kernel == "rbf" else []
    svm = LinearSVC(
        featuresCol="fourier" if mapped else "features",
        rawPredictionCol="margin",
        predictionCol=prediction,
        regParam=1.0 / (C * rows),
        maxIter=iterations,
    )
    return [*mapped, svm]


class PenaltySVM(Estimator):
    """Linear SVM whose regularisation is what the penalty C means for the rows it is fitted on."""

    def __init__(self, C: float, features: str = "features", **params):
        super().__init__()
        self.C, self.svm = C, LinearSVC(featuresCol=features, **params)

    def _fit(self, df: DataFrame) -> Transformer:
        return self.svm.copy({self.svm.regParam: 1.0 / (self.C * max(1, df.count()))}).fit(df)


def svm_grid(points: list[dict], size: int = 256, iterations: int = 100) -> dict:
    """What `tune` needs for points (C, gamma, kernel): the points of a gamma share one table of features, and a linear kernel has no gamma."""

    def build(point: dict) -> Estimator:
        return PenaltySVM(point["C"], "fourier" if point["kernel"] == "rbf" else "features", maxIter=iterations)

    def shared(point: dict) -> Transformer | None:
        return FourierFeatures(gamma=point["gamma"], size=size) if point["kernel"] == "rbf" else None

    def same(point: dict) -> dict:
        return point if point["kernel"] == "rbf" else {k: v for k, v in point.items() if k != "gamma"}

    return {"build": build, "points": points, "same": same, "shared": shared, "shared_key": lambda p: p["gamma"] if p["kernel"] == "rbf" else None}


def svm_with_probability(
    encoded: DataFrame, fold_col: str, kernel: str = "rbf", C: float = 1.0, gamma: float = 0.1, iterations: int = 100
) -> PipelineModel:
    """SVM on all rows, and a logistic curve from margin to probability fitted on out-of-fold margins; C means the same in every fit."""
    folds = [r[0] for r in encoded.select(fold_col).distinct().collect()]
    rows = encoded.count()
    stages = svm_stages(rows, kernel, C, gamma, iterations=iterations, prediction="svm_class")
    margins = []
    for fold in folds:
        others = encoded.filter(F.col(fold_col) != fold)
        of_fold = svm_stages(others.count(), kernel, C, gamma, iterations=iterations, prediction="svm_class")
        model = Pipeline(stages=of_fold).fit(others)
        margins.append(model.transform(encoded.filter(F.col(fold_col) == fold)).select("label", "margin"))
    signed = VectorSlicer(inputCol="margin", outputCol="signed_margin", indices=[1])
    curve = LogisticRegression(featuresCol="signed_margin")
    platt = Pipeline(stages=[signed, curve]).fit(reduce(DataFrame.unionByName, margins))
    return PipelineModel(stages=Pipeline(stages=stages).fit(encoded).stages + platt.stages)


def network(width: int, iterations: int = 40, seed: int = 42, **params) -> MultilayerPerceptronClassifier:
    """Two hidden layers of 256 sigmoid units; the library has neither batch normalisation nor ReLU."""
    return MultilayerPerceptronClassifier(layers=[width, 256, 256, 2], maxIter=iterations, seed=seed, **params)


def with_class_weight(df: DataFrame, label: str = "label", name: str = "class_weight") -> DataFrame:
    """Positives weigh negatives / positives, negatives weigh 1."""
    counts = df.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    ratio = counts[0] / counts[1] if counts[1] else 1.0
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


def score_table(model: Transformer, df: DataFrame, keep: list[str]) -> DataFrame:
    """Predicted class and probability of class 1 beside the kept columns."""
    scored = model.transform(df)
    return scored.select(
        *keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("prob")
    )


def in_parallel(work: Callable, items: list, parallelism: int) -> list:
    """Results of work on each item, in order; up to `parallelism` Spark jobs run side by side."""
    if parallelism <= 1 or len(items) <= 1:
        return [work(x) for x in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(work), items, chunksize=1)


def oof_predict(estimator: Estimator, df: DataFrame, fold_col: str, keep: list[str], parallelism: int = 4) -> DataFrame:
    """Class and probability of every row from the model that was fitted without its fold; folds are fitted side by side."""

    def scored(fold) -> DataFrame:
        model = estimator.fit(df.filter(F.col(fold_col) != fold))
        return score_table(model, df.filter(F.col(fold_col) == fold), [*keep, fold_col])

    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    return reduce(DataFrame.unionByName, in_parallel(scored, folds, parallelism))


def grid_points(grid: dict[str, list]) -> list[dict]:
    points: list[dict] = [{}]
    for name, options in grid.items():
        points = [p | {name: v} for p in points for v in options]
    return points


def evaluator(metric: str, label: str = "label") -> Evaluator:
    if metric == "accuracy":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC", numBins=0)


def shortened(model: Transformer, trees: int) -> Transformer:
    """The ensemble of the first trees of a fitted one, as the last stage where the model is a pipeline.

    Boosting adds a tree a round, each with a seed of its own, so this is the model that a fit of so many rounds gives. A forest's trees are drawn
    independently, so it is a forest of that size, though not the one that a fit of that size draws.
    """
    if isinstance(model, PipelineModel):
        return PipelineModel([*model.stages[:-1], shortened(model.stages[-1], trees)])
    java = model._java_obj
    context = SparkSession.active().sparkContext
    package, name = java.getClass().getName().rsplit(".", 1)
    fitted = java.trees()
    if trees >= len(fitted):
        return model
    first = context._gateway.new_array(getattr(getattr(context._jvm, fitted[0].getClass().getName().rsplit(".", 1)[0]), fitted[0].getClass().getSimpleName()), trees)
    for i in range(trees):
        first[i] = fitted[i]
    make = getattr(getattr(context._jvm, package), name)
    if isinstance(model, (GBTClassificationModel, GBTRegressionModel)):
        weights = context._gateway.new_array(context._gateway.jvm.double, trees)
        for i, w in enumerate(model.treeWeights[:trees]):
            weights[i] = w
        rest = [model.numFeatures] + ([model.numClasses] if isinstance(model, GBTClassificationModel) else [])
        made = make(java.uid(), first, weights, *rest)
    else:
        rest = [model.numFeatures] + ([model.numClasses] if isinstance(model, RandomForestClassificationModel) else [])
        made = make(java.uid(), first, *rest)
    count = "maxIter" if java.hasParam("maxIter") else "numTrees"
    for column in ("FeaturesCol", "PredictionCol"):
        getattr(made, f"set{column}")(getattr(java, f"get{column}")())
    made.set(made.getParam(count), trees)
    return type(model)(made)


#: Grid parameters that count the trees of an ensemble, so that one fit of the most of them answers every smaller value.
TREE_COUNTS = ("maxIter", "numTrees")


def _fits(points: list[dict], same: Callable[[dict], dict]) -> list[tuple[dict, list[tuple[int, int | None]]]]:
    """The points to be fitted, each with the numbers of the grid points that it answers and their number of trees."""
    groups: dict[str, tuple[dict, list[tuple[int, int | None]]]] = {}
    for number, point in enumerate(points):
        counted = next((c for c in TREE_COUNTS if c in point), None)
        rest = same({k: v for k, v in point.items() if k != counted})
        trees = point[counted] if counted else None
        most, answered = groups.setdefault(f"{counted}{sorted(rest.items(), key=str)}", (point, []))
        if trees is not None and trees > most[counted]:
            most = point
        answered.append((number, trees))
        groups[f"{counted}{sorted(rest.items(), key=str)}"] = (most, answered)
    return list(groups.values())


def _by_key(fits: list[tuple], key: Callable[[dict], object]) -> dict[object, tuple[dict, list[tuple]]]:
    """The fits of each key, with the point of the first."""
    groups: dict[object, tuple[dict, list[tuple]]] = {}
    for fit in fits:
        groups.setdefault(key(fit[0]), (fit[0], []))[1].append(fit)
    return groups


def tune(
    encoder: Pipeline | None, build: Callable[[dict], Estimator], points: list[dict], df: DataFrame, metric: str, fold_col: str,
    parallelism: int = 4, same: Callable[[dict], dict] = dict,
    shared: Callable[[dict], Transformer | None] = lambda point: None, shared_key: Callable[[dict], object] = lambda point: None,
) -> tuple[DataFrame, dict]:
    """All grid points on all folds: the table (point, params, fold, metric, best) and the best point.

    build makes the estimator of a point. The encoder is fitted once per fold, on the other folds, and its output
    is kept for all grid points; without one, the estimator takes the rows as they are. Points that differ only in their number of trees are one fit
    of the most trees, and each is judged by its first trees; so are points that `same` maps to the same parameters. Fits of all folds run side by side.
    `shared` gives the transformer that a point needs before its estimator; it runs once a fold for all points of one `shared_key`.
    The best mean metric wins, and the first of equal ones.
    """
    judge = evaluator(metric)
    folds = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    kept: dict[object, tuple[DataFrame, DataFrame]] = {}

    def prepared(fold) -> None:
        train, held_out = df.filter(F.col(fold_col) != fold), df.filter(F.col(fold_col) == fold)
        if encoder is not None:
            encode = encoder.fit(train)
            train, held_out = encode.transform(train), encode.transform(held_out)
        kept[fold] = train.persist(), held_out.persist()

    def mapped(work: tuple) -> None:
        fold, key, point = work
        change = shared(point)
        if change is not None:
            kept[fold, key] = tuple(change.transform(frame).persist() for frame in kept[fold])

    def judged(work: tuple) -> list[tuple]:
        fold, (point, answered) = work
        train, held_out = kept.get((fold, shared_key(point)), kept[fold])
        model = build(point).fit(train)
        values = {trees: float(judge.evaluate((model if trees is None else shortened(model, trees)).transform(held_out))) for trees in {t for _, t in answered}}
        return [(number, str(points[number]), int(fold), values[trees]) for number, trees in answered]

    in_parallel(prepared, folds, parallelism)
    rows = []
    for key, (first, fits) in _by_key(_fits(points, same), shared_key).items():
        in_parallel(mapped, [(fold, key, first) for fold in folds], parallelism)
        rows += sum(in_parallel(judged, [(fold, fit) for fold in folds for fit in fits], parallelism), [])
        for fold in folds:
            for frame in kept.pop((fold, key), ()):
                frame.unpersist()
    for pair in kept.values():
        for frame in pair:
            frame.unpersist()
    means = [np.mean([m for i, _, _, m in rows if i == k]) for k in range(len(points))]
    best = int(np.argmax(means))
    table = df.sparkSession.createDataFrame(
        [(*row, row[0] == best) for row in sorted(rows)], "point int, params string, fold int, metric double, best boolean"
    )
    return table, points[best]


def fit_best(encoder: Pipeline | None, build: Callable[[dict], Estimator], point: dict, train: DataFrame) -> PipelineModel:
    """Refit of the best grid point on all training rows."""
    return Pipeline(stages=[*([encoder] if encoder is not None else []), build(point)]).fit(train)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def train_history(
    train: DataFrame, test: DataFrame, width: int, stages: int, iterations: int, seed: int = 42
) -> DataFrame:
    """Loss and accuracy on train, accuracy and AUC on test, after every few iterations.

    Each stage continues from the weights of the stage before.
    """
    spark: SparkSession = train.sparkSession
    rows = []
    weights = None
    for stage in range(1, stages + 1):
        fit = network(width, iterations, seed)
        if weights is not None:
            fit = fit.setInitialWeights(weights)
        model: MultilayerPerceptronClassificationModel = fit.fit(train)
        weights = model.weights
        seen, held_out = (cut_lineage(score_table(model, rows_of, ["label"])) for rows_of in (train, test))
        rows.append(
            (
                stage * iterations,
                float(model.summary().objectiveHistory[-1]),
                log_loss(seen, []).first()[0],
                accuracy_at(seen, [], 0.5, inclusive=True).first()[0],
                accuracy_at(held_out, [], 0.5, inclusive=True).first()[0],
                roc_auc(held_out, []).first()[0],
            )
        )
        for scored in (seen, held_out):
            discard(scored)
    schema = "iteration int, objective double, train_loss double, train_accuracy double, test_accuracy double, test_auc double"
    return spark.createDataFrame(rows, schema)


def encoded(
    numeric: list[str], categorical: list[str], train: DataFrame, scale: bool = False
) -> tuple[PipelineModel, int]:
    """Fitted preprocessor and the width of its vectors."""
    model = preprocessor(numeric, categorical, scale).fit(train)
    return model, len(model.transform(train).first()["features"])
