"""Tables with a row for each key of the data are not broadcast, however little the planner takes them for."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from trialweave.imaging import bricks, intensity, texture
from trialweave.operators import ranking, relational


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    rows = spark.range(200).select((F.col("id") % 20).cast("string").alias("k"), F.col("id").alias("v"), F.lit(1).alias("n"))
    return rows, spark.createDataFrame([(str(k), k * 10) for k in range(20)], "k string, w long")


def test_copies_for_salted_rows_are_shuffled(tables):
    rows, table = tables
    joined = relational.join_spread(rows, table, ["k"], ["v"])
    assert "Broadcast" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert sorted((r.k, r.v, r.w) for r in joined.collect()) == sorted((str(v % 20), v, v % 20 * 10) for v in range(200))


def test_offsets_of_groups_are_shuffled(tables):
    rows, _ = tables
    sums = ranking.running_sums(rows, ["k"], "v", {"upto": "n"}, [(50,), (100,), (150,)])
    assert "Broadcast" not in plan(sums)
    assert sorted((r.v, r.upto) for r in sums.collect()) == [(v, v // 20 + 1) for v in range(200)]


@pytest.fixture
def levels(spark):
    rows = [(f"i{k}", z, y, x, float(z + y * x + k), z + y + 1, 9) for k in range(5) for z, y, x in itertools.product(range(2), range(3), range(3))]
    return spark.createDataFrame(rows, "image string, z int, y int, x int, value double, g int, ng int")


def test_first_order_tables_are_shuffled(levels):
    assert "Broadcast" not in plan(intensity.firstorder(levels, ["image"]))


@pytest.mark.parametrize("family", ["glcm", "glrlm", "gldm", "ngtdm", "glszm"])
def test_texture_tables_are_shuffled(levels, family):
    around = texture.neighbour_cells(levels, ["image"])
    made = {
        "glcm": lambda: texture.glcm_features(texture.glcm_cells(levels, ["image"]), ["image"]),
        "glrlm": lambda: texture.size_features(texture.glrlm_cells(levels, ["image"]), ["image"], "glrlm"),
        "gldm": lambda: texture.size_features(texture.gldm_cells(around, ["image"]), ["image"], "gldm"),
        "ngtdm": lambda: texture.ngtdm_features(around, ["image"]),
        "glszm": lambda: texture.size_features(texture.glszm_cells(levels, ["image"]), ["image"], "glszm"),
    }[family]()
    assert "Broadcast" not in plan(made)


def test_a_written_table_is_broadcast_only_while_it_has_few_rows(levels, monkeypatch):
    voxels = levels.withColumn("mask", F.lit(1))
    few = bricks.with_extents(voxels, ["image"])
    assert "BroadcastHashJoin" in plan(few)
    monkeypatch.setattr(relational, "SENT_ROWS", 4)
    many = bricks.with_extents(voxels, ["image"])
    assert "Broadcast" not in plan(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
