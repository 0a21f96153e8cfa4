"""Cohort, random and stratified splits, and the weights that make one cohort look like another."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from trialweave.functions.transforms import clip
from trialweave.operators.ranking import hash_key, hash_positions, positions, smallest_hashes
from trialweave.operators.relational import aligned_counts, lookup

# Cohorts of the two fixed splits as (training, validation). Fixed values.
COHORT_SPLITS = {
    "9_12": (["lungmate-009"], ["lungmate-001", "lungmate-002"]),
    "19_2": (["lungmate-009", "lungmate-001"], ["lungmate-002"]),
}


def split_by_set(df: DataFrame, train: list[str], val: list[str], column: str = "set") -> tuple[DataFrame, DataFrame]:
    """Training and validation cohorts; rows of other cohorts are in neither."""
    return df.filter(F.col(column).isin(train)), df.filter(F.col(column).isin(val))


def mark_random(df: DataFrame, key: str, fraction: float = 0.3, seed: int = 21, name: str = "is_test") -> DataFrame:
    """Flag exactly ceil(fraction * rows) rows, the first in hash order of a unique key.

    The cut is one hash value, so marking the rows is a comparison without a shuffle.
    """
    n = math.ceil(fraction * df.count())
    cut = smallest_hashes(df, key, seed, n)
    return df.withColumn(name, hash_key(key, seed) <= F.lit(cut) if cut else F.lit(False))


def split_random(df: DataFrame, key: str, fraction: float = 0.3, seed: int = 21) -> tuple[DataFrame, DataFrame]:
    marked = mark_random(df, key, fraction, seed)
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int | None = 42) -> DataFrame:
    """Class-balanced fold number; shuffled by the seed, or in key order without one."""
    if seed is None:
        ranked = positions(df, [label], [key], "_position")
    else:
        ranked = hash_positions(df, [label], key, seed, "_position")
    return ranked.withColumn("fold", (F.col("_position") % k).cast("int")).drop("_position")


def target_weights(
    train: DataFrame, val: DataFrame, keys: list[str], low: float = 0.5, high: float = 2.0, normalize: bool = False
) -> DataFrame:
    """Validation count over training count per key combination, bounded; x/0 is infinite and so the bound.

    normalize divides each count by its table's total first.
    """
    counts = aligned_counts(train, val, keys, ("n_train", "n_val"))
    ratio = F.col("n_val") / F.nullif(F.col("n_train"), F.lit(0))
    if normalize:
        ratio = ratio * F.lit(train.dropna(subset=keys).count() / val.dropna(subset=keys).count())
    weight = F.when(F.col("n_train") == 0, F.lit(float(high))).otherwise(clip(ratio, low, high))
    return counts.select(*keys, "n_train", "n_val", weight.alias("weight"))


def reweight(train: DataFrame, val: DataFrame, keys: list[str], low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Training rows with the weight of their key combination; rows without one weigh 1."""
    return lookup(train, target_weights(train, val, keys, low, high), keys, "weight", F.lit(1.0))
