"""Region of interest, geometry checks, normalisation, grey levels and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from trialweave.imaging.bricks import CONSTANTS, SIZE, Made, Stack, bounds, brick_of, over_bricks, with_extents
from trialweave.imaging.lines import AXES
from trialweave.operators.relational import join_spread, unsent
from trialweave.session import cut_lineage


def voxel_mask(df: DataFrame, label: int = 1) -> DataFrame:
    return df.filter(F.col("mask") == label)


def _extents(df: DataFrame, suffix: str) -> DataFrame:
    sizes = [(F.max(a) + 1).alias(f"n_{a}_{suffix}") for a in AXES]
    return df.groupBy("image_name").agg(*sizes, F.count("*").alias(f"n_voxels_{suffix}"))


def geometry_check(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Extents and voxel counts of image and mask side by side, and whether they agree."""
    joined = _extents(images, "image").join(_extents(masks, "mask"), "image_name", "full_outer")
    same = F.lit(True)
    for n in ("n_z", "n_y", "n_x", "n_voxels"):
        same = same & F.col(f"{n}_image").eqNullSafe(F.col(f"{n}_mask"))
    return joined.withColumn("geometry_ok", same)


def image_faults(voxels: DataFrame, masks: DataFrame, label: int = 1, plan: DataFrame | None = None) -> DataFrame:
    """One row per image: (image_name, reason), with a null reason for a usable one.

    With a resampling plan, an image that has no row in it, or an extent there that is null or below 1, is reported as "no grid".
    """
    geometry = geometry_check(voxels, masks)
    content = voxels.groupBy("image_name").agg(
        F.count_if(F.col("mask") == label).alias("n_region"),
        F.count_if((F.col("mask") == label) & F.col("value").isNull()).alias("n_null"),
    )
    reason = (
        F.when(~F.col("geometry_ok"), "geometry")
        .when(F.col("n_region") == 0, "empty mask")
        .when(F.col("n_region") == 1, "single voxel")
        .when(F.col("n_null") > 0, "missing values")
        .when(F.col("n_voxels_image") != F.col("n_z_image") * F.col("n_y_image") * F.col("n_x_image"), "gap")
    )
    joined = geometry.join(unsent(content), "image_name", "left")
    if plan is not None:
        fits = F.lit(True)
        for a in AXES:
            fits = fits & F.coalesce(F.col(f"new_n_{a}") >= 1, F.lit(False))
        grids = plan.groupBy("image_name").agg(F.bool_and(fits).alias("_fits"))
        joined = joined.join(unsent(grids), "image_name", "left")
        reason = F.coalesce(reason, F.when(~F.coalesce("_fits", F.lit(False)), "no grid"))
    return joined.select("image_name", reason.alias("reason"))


def quarantine(voxels: DataFrame, masks: DataFrame, plan: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Voxels of usable images, and the other images with the reason; a bad image never stops the job.

    An image that is to be resampled needs a row with valid extents in the plan."""
    faults = image_faults(voxels, masks, plan=plan)
    bad = faults.filter(F.col("reason").isNotNull())
    return voxels.join(bad.select("image_name"), "image_name", "left_anti"), bad


def intensity_normalize(
    df: DataFrame, keys: list[str], outliers: float | None = None, scale: float = 1.0
) -> DataFrame:
    """(value - mean) / std over the whole image, optionally clipped at +-outliers, then scaled."""
    stats = df.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    spread = F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std"))
    value: Column = (F.col("value") - F.col("_mean")) / spread
    if outliers is not None:
        value = F.least(F.greatest(value, F.lit(-float(outliers))), F.lit(float(outliers)))
    return join_spread(df, stats, keys, AXES).withColumn("value", value * F.lit(float(scale))).drop("_mean", "_std")


def discretize(roi: DataFrame, keys: list[str], width: float = 25) -> DataFrame:
    """Grey level g = floor(value / width) - floor(smallest / width) + 1 inside the region, and its largest ng."""
    bins = F.lit(float(width))
    ends = roi.groupBy(*keys).agg(
        F.floor(F.min("value") / bins).alias("_first"), F.floor(F.max("value") / bins).alias("_last")
    )
    g = F.floor(F.col("value") / bins) - F.col("_first") + 1
    ng = F.col("_last") - F.col("_first") + 1
    levels = join_spread(roi, ends, keys, AXES).withColumns({"g": g.cast("int"), "ng": ng.cast("int")})
    return levels.drop("_first", "_last")


def resample_plan(df: DataFrame, target: float = 1.0) -> DataFrame:
    """Per image (n_z.., spacing_z..): the new extents rint(n * spacing / target), zoom and real spacing."""
    for a in AXES:
        new = F.rint(F.col(f"n_{a}") * (F.col(f"spacing_{a}") / F.lit(target))).cast("int")
        df = df.withColumn(f"new_n_{a}", new)
        df = df.withColumn(f"zoom_{a}", F.col(f"new_n_{a}") / F.col(f"n_{a}"))
        df = df.withColumn(f"new_spacing_{a}", F.col(f"spacing_{a}") / F.nullif(F.col(f"zoom_{a}"), F.lit(0.0)))
    return df


def _needed(axis: str, size: int) -> Column:
    """Bricks of the new grid with a point that a voxel of the old one can take part in: those around its place, with a point to spare on both sides."""
    i, n_in, n_out = F.col(axis) - F.col(f"o_{axis}"), F.col(f"n_{axis}"), F.col(f"new_n_{axis}")
    ratio = (n_out - 1).cast("double") / F.nullif(n_in - 1, F.lit(0))
    low = F.greatest(F.coalesce(F.ceil((i - 1) * ratio) - 1, F.lit(0)), F.lit(0))
    high = F.least(F.coalesce(F.floor((i + 1) * ratio) + 1, n_out - 1), n_out - 1)
    met = F.sequence(brick_of(low, n_out, size), brick_of(high, n_out, size))
    return F.when((n_out > 0) & (low <= high), met).otherwise(F.array().cast("array<int>"))


def _sources(points: np.ndarray, n_in: int, n_out: int) -> np.ndarray:
    """Positions in the old line of points of the new one; first and last points coincide."""
    return points.astype(float) * (n_in - 1) / (n_out - 1) if n_out > 1 else np.zeros(len(points))


def resample_volume(voxels: DataFrame, plan: DataFrame, size: int = SIZE) -> DataFrame:
    """(image_name, z, y, x, value, mask): image by linear, mask by nearest interpolation on the grid of the plan (image_name, new_n_z, new_n_y, new_n_x).

    Only images with valid extents in the plan have a grid; quarantine with the plan reports the others. The new grid is cut into bricks, and a
    voxel goes to those whose points lie beside it, so all three axes take one shuffle. Linear interpolation in space is the product of the
    three axes, done one after the other. A point beside a missing voxel has no value.
    """
    sizes = [f"new_n_{a}" for a in AXES]
    grid = cut_lineage(plan.select("image_name", *sizes))
    known = with_extents(voxels.select("image_name", *AXES, F.col("value").cast("double").alias("value"), "mask"), ["image_name"]).join(grid, "image_name")

    def brick(stack: Stack) -> Made:
        own, low, high, weight, nearest = {}, {}, {}, {}, {}
        for a in AXES:
            n_in, n_out = stack.cells[f"n_{a}"], stack.extents[a]
            own[a] = np.arange(*bounds(stack.numbers[a], n_out, size))
            at = _sources(own[a], n_in, n_out)
            low[a] = np.floor(at).astype(np.int64)
            high[a] = np.minimum(low[a] + 1, n_in - 1)
            weight[a] = at - low[a]
            nearest[a] = np.floor(at + 0.5).astype(np.int64)
        both = {a: np.concatenate([low[a], high[a]]) for a in AXES}
        wide, _ = stack.dense(both, ["value"])
        value = wide["value"]
        for k, a in enumerate(AXES):
            n = len(own[a])
            w = weight[a].reshape((1,) * (k + 1) + (n,) + (1,) * (2 - k))
            value = np.take(value, np.arange(n), axis=k + 1) * (1 - w) + np.take(value, np.arange(n, 2 * n), axis=k + 1) * w
        mask, _ = stack.dense(nearest, ["mask"])
        return own, {"value": value, "mask": mask["mask"]}, np.ones(value.shape, bool)

    targets = {a: _needed(a, size) for a in AXES}
    out = over_bricks(known, ["image_name"], [*CONSTANTS, *sizes], {a: f"new_n_{a}" for a in AXES}, targets, ["value"], ["value"], brick, origin=False)
    return out.select("image_name", *AXES, "value", "mask")
