"""Voxel rows gathered into lines, the unit in which neighbours are looked up and axes are filtered.

A line is one row of a volume along an axis, so it is bounded by the scanner's matrix, while its key holds
the image and two coordinates: a single huge image still spreads over as many tasks as it has lines.
Shipping lines instead of voxels keeps the shuffle small, since a neighbour lookup sends each line
to at most eight others and not each voxel to 26.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

AXES = ["z", "y", "x"]


def grey_lines(levels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z, y, x0, g): grey levels along x from x0 on, null where a voxel is not in the region."""
    cells = levels.groupBy(*keys, "z", "y").agg(F.array_sort(F.collect_list(F.struct("x", "g"))).alias("cells"))

    def with_gap(cell: Column, i: Column) -> Column:
        before = F.get(F.col("cells"), i - 1)["x"]
        gap = F.when(i == 0, F.lit(0)).otherwise(cell["x"] - before - 1)
        return F.concat(F.array_repeat(F.lit(None).cast("int"), gap), F.array(cell["g"]))

    return cells.select(
        *keys, "z", "y", F.col("cells")[0]["x"].alias("x0"), F.flatten(F.transform("cells", with_gap)).alias("g")
    )


def with_neighbour_lines(lines: DataFrame, keys: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """Each line with the lines that lie (dz, dy) before it, for the offsets given: at most one per offset."""
    steps = F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in [(0, 0), *offsets]])
    sent = lines.withColumn("step", F.explode(steps))
    gathered = sent.groupBy(
        *keys, (F.col("z") + F.col("step.dz")).alias("z"), (F.col("y") + F.col("step.dy")).alias("y")
    ).agg(F.collect_list(F.struct("step.dz", "step.dy", "x0", "g")).alias("around"))
    own = F.filter("around", lambda s: (s["dz"] == 0) & (s["dy"] == 0))
    return (
        gathered.withColumn("own", F.get(own, F.lit(0)))
        .filter(F.col("own").isNotNull())
        .select(*keys, "z", "y", F.col("own.x0").alias("x0"), F.col("own.g").alias("g"), "around")
    )


def beside(source: Column, x: Column) -> Column:
    """Grey level of a neighbour line at coordinate x, null outside of it."""
    return F.get(source["g"], x - source["x0"])
