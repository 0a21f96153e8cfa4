"""File trees as tables: listing, pairing of images with masks, and the work that is still open."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.sources.listing import list_folder


def manifest(spark: SparkSession, root: str, pattern: str, names: list[str], glob: str = "*", tasks: int = 64, depth: int = 1) -> DataFrame:
    """(path, name, length, modified) of the files under root whose name matches glob, with the groups of pattern as columns, which replace columns of that name. Folders are
    listed in tasks and contents are never read."""
    files = list_folder(spark, root, tasks, depth)
    matching = files if glob == "*" else files.filter(F.col("name").rlike(fnmatch.translate(glob)))
    return parse_paths(matching.drop(*names), pattern, names)


def parse_paths(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    return df.select("*", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def skip_hidden(df: DataFrame, name: str = "name") -> DataFrame:
    return df.filter(~F.col(name).startswith("."))


def with_suffix(df: DataFrame, suffix: str, name: str = "name") -> DataFrame:
    return df.filter(F.col(name).endswith(suffix))


def pending(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Inputs without an output yet, so that a stopped job can be run again."""
    return df.join(done.select(*on).distinct(), on, "left_anti")


def paired(images: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    """Images that have a mask; the mask keys are made distinct first, so a hot key stays on one side."""
    return images.join(masks.select(*on).distinct(), on, "left_semi")


def unpaired(images: DataFrame, masks: DataFrame, on: list[str]) -> DataFrame:
    return images.join(masks.select(*on).distinct(), on, "left_anti")


def earliest_per_key(df: DataFrame, key: str, date: str, path: str) -> DataFrame:
    """Baseline scan: the path of the earliest date per key, over all dates; ties go to the smaller path."""
    order = F.struct(date, path)
    return df.groupBy(key).agg(F.min_by(F.col(path), order).alias(path), F.min(date).alias(date))
