"""Feature importances, shadow-feature selection and additive attributions of tree models."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.operators import models
from trialweave.operators.models import MAX_DEPTH, SPREAD, forest_classifier
from trialweave.operators.ranking import hash_key
from trialweave.operators.relational import above_nth_largest, top_k
from trialweave.session import cut_lineage, scratch_path

#: Forests are much work for a row, so that a small table is spread as well.
training_layout = partial(models.training_layout, spread=SPREAD)


def importance_table(spark: SparkSession, model: Model, columns: list[str]) -> DataFrame:
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(columns, values)), "feature string, importance double")


def rank_features(
    df: DataFrame, columns: list[str], label: str, key: str, trees: int = 100, seed: int = 21, depth: int = MAX_DEPTH
) -> DataFrame:
    """(feature, importance) of a forest on the given rows; pass training cohorts only. Nulls count as the mean of their column, or 0 without one."""
    means = df.agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns]).first()
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(means[c] or 0.0)) for c in columns}
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(df.withColumns(filled))
    forest = forest_classifier(trees, seed, labelCol=label, maxDepth=depth)
    model = models.InParts(forest).fit(training_layout(vectors.select(key, label, "features"), key))
    return importance_table(df.sparkSession, model, columns)


def select_features_by(df: DataFrame, importances: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """The table with the columns in `keep` and the features strictly above the n-th largest importance, in the table's order."""
    chosen = {r.feature for r in above_nth_largest(importances, "importance", n).select("feature").collect()}
    return df.select(*keep, *[c for c in df.columns if c in chosen and c not in keep])


#: Rows of a block, inside which columns are shuffled, and rounds between two looks at the hits.
BLOCK_ROWS, LOOK = 4096, 4


def shuffle_blocks(df: DataFrame, columns: list[str], label: str, key: str, seed: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, labels, features): rows dealt once into random blocks of about `block_rows`; features is one flat array, row after row.

    Rows meet by the hash of their key, so equal keys share a block. Nulls count as the mean of their column, or 0 without one.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    first = df.agg(F.count("*"), *[F.avg(v) for v in value.values()]).first()
    blocks = max(1, math.ceil(first[0] / block_rows))
    row = F.array(*[F.coalesce(v, F.lit(mean if mean is not None else 0.0)) for v, mean in zip(value.values(), first[1:])])
    dealt = df.select(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).alias("block"), hash_key(key, seed).alias("order"), F.col(label).cast("double").alias("label"), row.alias("row"))
    packed = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("order", "label", "row"))).alias("rows"))
    return packed.select("block", F.col("rows.label").alias("labels"), F.flatten("rows.row").alias("features"))


def with_shadows(blocks: DataFrame, kept: list[int], width: int, seed: int) -> DataFrame:
    """(label, features) with the kept columns and, behind them, a copy of each that is shuffled on its own inside its block; nothing is joined or moved."""

    def shuffled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                labels = np.asarray(part.column(1)[i].values)
                table = np.asarray(part.column(2)[i].values).reshape(len(labels), width)[:, kept]
                copies = np.random.default_rng((seed, part.column(0)[i].as_py())).permuted(table, axis=0)
                both = np.hstack([table, copies])
                offsets = pa.array(np.arange(len(labels) + 1, dtype=np.int32) * both.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(labels), pa.ListArray.from_arrays(offsets, pa.array(both.ravel()))], names=["label", "row"])

    rows = blocks.select("block", "labels", "features").mapInArrow(shuffled, "label double, row array<double>")
    return rows.select("label", array_to_vector("row").alias("features"))


def _tail(hits: int, rounds: int) -> float:
    """Chance of at least this many hits in fair coin tosses."""
    return sum(math.comb(rounds, k) for k in range(hits, rounds + 1)) / 2**rounds


def step_down(chances: dict[str, float], tested: int, limit: float) -> set[str]:
    """Holm: from the least chance on, while it is at most the limit over the hypotheses that are left of `tested`."""
    passed = set()
    for n, (name, chance) in enumerate(sorted(chances.items(), key=lambda x: (x[1], x[0]))):
        if chance > limit / max(1, tested - n):
            break
        passed.add(name)
    return passed


def shadow_select(
    df: DataFrame, columns: list[str], label: str, key: str, rounds: int = 100, trees: int = 50, seed: int = 42,
    alpha: float = 0.05, depth: int = 7, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(feature, hits, rounds, ranking): a hit is an importance above the best shuffled copy of any column still in question.

    Every few rounds, hits are tested against fair coin tosses, for keeping and for rejecting, with a step-down correction over the columns and a
    share of alpha for each look: up to round r of R, alpha (r / R)^3 has been spent. So the chance that any column is kept wrongly stays below alpha, and
    likewise that any is rejected wrongly. Rejected columns leave the forests, kept ones stay in them; it ends when all are decided, or after `rounds`. The rounds that a
    decision takes grow with the logarithm of the columns (16 of 100 for 5 columns and 24 for 300, where the hits are clear).

    ranking 1 is kept and 2 undecided; rejected columns follow as 3, 4, 5, ... by falling share of hits and mean importance (equal ones share a
    rank), so a limit on the ranking takes the best of them. Rows are shuffled inside random blocks that are made once. No columns: no rows.
    """
    width = len(columns)
    blocks = cut_lineage(shuffle_blocks(df, columns, label, key, seed, block_rows)) if columns else None
    hits, total, seen = dict.fromkeys(columns, 0), dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 0)
    kept: set[str] = set()
    rejected: set[str] = set()
    last = 0
    for r in range(1, rounds + 1):
        open_ = [c for c in columns if c not in kept and c not in rejected]
        if not open_:
            break
        here = [c for c in columns if c not in rejected]
        rows = with_shadows(blocks, [columns.index(c) for c in here], width, seed + r).persist()
        importance = forest_classifier(trees, seed + r, labelCol="label", maxDepth=depth).fit(rows).featureImportances.toArray()
        rows.unpersist()
        bar = max(importance[len(here) :])
        for c, value in zip(here, importance):
            if c not in kept:
                hits[c] += bool(value > bar)
                total[c] += float(value)
                seen[c] += 1
        if r % LOOK and r < rounds:
            continue
        limit = alpha * (r**3 - last**3) / rounds**3
        last = r
        good = step_down({c: _tail(hits[c], r) for c in open_}, width - len(kept), limit)
        bad = step_down({c: _tail(r - hits[c], r) for c in open_}, width - len(rejected), limit)
        kept |= good
        rejected |= bad
    order = sorted({(-hits[c] / seen[c], -total[c] / seen[c]) for c in rejected})
    table = [(c, hits[c], seen[c], 3 + order.index((-hits[c] / seen[c], -total[c] / seen[c])) if c in rejected else 1 if c in kept else 2) for c in columns]
    return df.sparkSession.createDataFrame(table, "feature string, hits int, rounds int, ranking int")


@dataclass
class Leaf:
    """Path to a leaf: per distinct feature its tests and the share of training rows that pass them."""

    value: float
    features: list[int]
    shares: list[float]
    tests: list[list[tuple]]


#: Leaves of a block, rows of a block, and nodes of the trees that one task walks (a larger tree is a task of its own).
LEAVES, ROWS, NODES = 1000, 2048, 4000


def _merged(tests: list[tuple]) -> list[tuple]:
    """The tests of one feature on a path: thresholds come down to the lowest and the highest one that still matter."""
    below = [t[1][0] for t in tests if not t[0] and t[2]]
    above = [t[1][0] for t in tests if not t[0] and not t[2]]
    return [t for t in tests if t[0]] + ([(False, (min(below),), True)] if below else []) + ([(False, (max(above),), False)] if above else [])


def leaf_table(spark: SparkSession, model: Model, leaves: int = LEAVES, nodes_of_task: int = NODES) -> DataFrame:
    """(block, base, leaves): the leaves of all trees with weighted values, in blocks of at most so many; base is the part of the mean output
    over the training rows that the block holds.

    The node table is the one the model writes when it is saved. Trees are walked in tasks and their leaves stay in the table.
    """
    path = scratch_path(spark, "tree-model")
    model.write().save(path)
    boosted = "GBT" in type(model).__name__
    weights = list(model.treeWeights) if boosted else [1.0 / len(model.trees)] * len(model.trees)
    is_class = not boosted and "Classification" in type(model).__name__
    nodes = spark.read.parquet(f"{path}/data")
    groups = max(1, min(len(weights), nodes.count() // nodes_of_task))
    split = F.col("nodeData.split")
    flat = nodes.select(
        F.pmod(F.col("treeID"), F.lit(groups)).alias("task"), F.col("treeID").cast("int").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats").alias("stats"), F.col("nodeData.rawCount").cast("double").alias("n"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        split["featureIndex"].alias("feature"), split["leftCategoriesOrThreshold"].alias("test"), (split["numCategories"] >= 0).alias("categorical"),
    )

    def walk(task: pd.DataFrame) -> pd.DataFrame:
        number = int(task["task"].iloc[0])
        blocks: list[tuple] = []
        held: list[tuple] = []
        base = 0.0

        def close() -> None:
            blocks.append((f"{number}:{len(blocks)}", base, json.dumps(held)))

        for tree, rows in task.groupby("tree"):
            by = {r.id: r for r in rows.itertuples(index=False)}
            todo = [(by[0], 1.0, {})]
            while todo:
                node, share, path = todo.pop()
                if node.left < 0:
                    value = weights[tree] * (node.stats[1] / sum(node.stats) if is_class else node.prediction)
                    held.append((value, list(path), [s for s, _ in path.values()], [_merged(t) for _, t in path.values()]))
                    base += share * value
                    if len(held) == leaves:
                        close()
                        held, base = [], 0.0
                    continue
                children = [by[node.left], by[node.right]]
                for child, goes_left in zip(children, (True, False)):
                    part = child.n / sum(c.n for c in children)
                    earlier, tests = path.get(node.feature, (1.0, []))
                    step = (bool(node.categorical), tuple(float(x) for x in node.test), goes_left)
                    todo.append((child, share * part, path | {int(node.feature): (earlier * part, [*tests, step])}))
        if held or not blocks:
            close()
        return pd.DataFrame(blocks, columns=["block", "base", "leaves"])

    return flat.groupBy("task").applyInPandas(walk, "block string, base double, leaves string")


def _passes(x: np.ndarray, leaf: Leaf) -> np.ndarray:
    """(rows, features of the path): whether a row takes the path at every test of the feature."""
    passed = np.ones((len(x), len(leaf.features)), dtype=bool)
    for k, (feature, tests) in enumerate(zip(leaf.features, leaf.tests)):
        for categorical, test, goes_left in tests:
            left = np.isin(x[:, feature], test) if categorical else x[:, feature] <= test[0]
            passed[:, k] &= left if goes_left else ~left
    return passed


def attributions(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Shapley values of the tree sum, with absent features following the training shares.

    For one leaf the value of a coalition is a product over its d path features. The Shapley weights of the subsets are the integrals of
    t^s (1 - t)^(d - 1 - s) over [0, 1], so a feature's share is the integral of the product of the other features' factors share (1 - t) + passed t:
    a polynomial of degree d - 1, which Gauss-Legendre nodes integrate exactly. One product serves all features of the leaf.
    """
    result = np.zeros(x.shape)
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        passed, shares = _passes(x, leaf).astype(float), np.array(leaf.shares)
        nodes, weights = np.polynomial.legendre.leggauss(d // 2 + 1)
        t, weights = (nodes + 1) / 2, weights / 2
        factors = shares[None, :, None] * (1 - t) + passed[:, :, None] * t
        others = factors.prod(axis=1)[:, None, :] / factors
        result[:, leaf.features] += leaf.value * (passed - shares) * (others @ weights)
    return result


def shap_values(model: Model, df: DataFrame, columns: list[str], key: str, leaves: int = LEAVES) -> DataFrame:
    """(key, feature, attribution, base): one row per input row and feature.

    The attributions of a row and the base add up to the margin of a boosted model, or to the probability
    of class 1 of a forest. Blocks of rows meet blocks of leaves, both of bounded size, so a model of any size is worked on in parts;
    with one block of leaves nothing is added up by a shuffle.
    """
    spark = df.sparkSession
    table = cut_lineage(leaf_table(spark, model, leaves))
    names = [r.block for r in table.select("block").orderBy("block").collect()]
    base = sum(r.base for r in table.select("block", "base").orderBy("block").collect())
    width = len(columns)
    rows = df.select(key, vector_to_array("features").alias("x"))
    key_type = dict(rows.dtypes)[key]

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, ROWS):
                some = part.slice(low, ROWS)
                keys = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                yield pa.RecordBatch.from_arrays([keys, pa.array([some.column(1).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary())], names=["keys", "x"])

    packed = rows.mapInArrow(pack, f"keys array<{key_type}>, x binary").withColumn("rows", F.monotonically_increasing_id())
    if len(names) > 1:
        packed = cut_lineage(packed)
    met = packed.withColumn("block", F.explode(F.array(*map(F.lit, names)))).join(table.select("block", "leaves"), "block")

    def explain(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, []
        for part in parts:
            for i in range(part.num_rows):
                block = part.column(3)[i].as_py()
                if block != last:
                    last, mine = block, [Leaf(*leaf) for leaf in json.loads(part.column(4)[i].as_py())]
                keys = part.column(1)[i].values
                values = attributions(np.frombuffer(part.column(2)[i].as_py()).reshape(len(keys), width), mine)
                offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), part.column(0)[i].as_py())), pa.array(np.arange(len(keys))), keys, pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
                    names=["rows", "at", "key", "attribution"],
                )

    explained = met.select("rows", "keys", "x", "block", "leaves").mapInArrow(explain, f"rows long, at long, key {key_type}, attribution array<double>")
    if len(names) > 1:
        sums = F.array(*[F.sum(F.col("attribution")[i]) for i in range(width)])
        explained = explained.groupBy("rows", "at").agg(F.first("key").alias("key"), sums.alias("attribution"))
    features = F.array(*[F.lit(c) for c in columns])
    return explained.select(
        F.col("key").alias(key),
        F.inline(F.arrays_zip(features.alias("feature"), F.col("attribution"))),
        F.lit(base).alias("base"),
    )


def shap_summary(values: DataFrame, k: int = 20) -> DataFrame:
    """Mean absolute attribution per feature, the k largest."""
    means = values.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    return top_k(means, "importance", "feature", k)
