"""Volumes as voxel tables, and the partitioned container they are stored in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def explode_volume(df: DataFrame, pixels: str, height: int, width: int) -> DataFrame:
    """One row per voxel from an array in (z, y, x) order."""
    kept = [c for c in df.columns if c != pixels]
    plane = height * width
    return df.select(*kept, F.posexplode(pixels).alias("pos", "value")).select(
        *kept,
        F.expr(f"cast(pos div {plane} as int)").alias("z"),
        F.expr(f"cast((pos div {width}) % {height} as int)").alias("y"),
        F.expr(f"cast(pos % {width} as int)").alias("x"),
        "value",
    )


def axis_permute(df: DataFrame) -> DataFrame:
    """(a, b, c) -> (c, b, a): masks are stored with their axes reversed against the image."""
    swapped = {"z": F.col("x").alias("z"), "x": F.col("z").alias("x")}
    return df.select([swapped.get(c, F.col(c)) for c in df.columns])


def write_volumes(df: DataFrame, path: str, buckets: int = 16, key: str = "image_name") -> None:
    """Voxels by hash bucket of the image: a fixed number of folders, however many images there are.

    Rows keep the tasks they are in, so one very large image is written by many tasks.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(path)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
