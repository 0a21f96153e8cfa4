"""Numeric column functions: target transforms, cuts, probability vectors and Hounsfield units."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TARGET_CUT = 1.3


def log1p_target(response: Column) -> Column:
    """log1p of the response in percent moved by one."""
    return F.log1p(response / 100 + 1)


def boxcox(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(float(lam))) - 1) / F.lit(float(lam))


def transform_cut(lam: float | None = None, cut: float = TARGET_CUT) -> float:
    """The cut on the transformed scale: log1p without lambda, Box-Cox with one."""
    if lam is None:
        return math.log1p(cut)
    return math.log(cut) if lam == 0 else (cut**lam - 1) / lam


def binarize(column: Column, cut: float | Column) -> Column:
    return (column > cut).cast("int")


def clip(column: Column, low: float, high: float) -> Column:
    """Bounds that keep null; least and greatest alone would skip it."""
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(float(low))), F.lit(float(high))))


def argmax_class(probabilities: Column) -> Column:
    """Index of the largest probability; the first one wins a tie."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def cut_values(low: float, high: float, n: int) -> list[float]:
    """n evenly spaced values, both ends included."""
    return [low] if n == 1 else [low + (high - low) * i / (n - 1) for i in range(n)]


def linspace(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced values between two columns as an array, both ends included."""
    step = (high - low) / F.lit(max(n - 1, 1)).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i.cast("double") * step)


def hounsfield(value: Column, slope: Column, intercept: Column) -> Column:
    """int16 voxels: out-of-scan values to 0, then the slope (truncated), then the intercept.

    A value beyond int16 becomes null and never stops the job; quarantine reports an image with such a voxel as "missing values".
    """
    inside = F.when(value < -1000, F.lit(0)).otherwise(value.try_cast("int"))
    scaled = F.when(slope != 1, (slope * inside.cast("double")).try_cast("int")).otherwise(inside)
    return F.try_add(scaled, intercept.try_cast("int")).try_cast("smallint")
