from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trialweave.imaging import texture
from trialweave.operators import models


def test_few_rows_of_much_work_are_dealt_to_several_partitions(spark):
    df = spark.range(5000).withColumn("key", F.col("id").cast("string"))
    assert models.training_layout(df, "key").rdd.getNumPartitions() == 1
    spread = models.training_layout(df, "key", spread=models.SPREAD)
    assert spread.rdd.getNumPartitions() == 5 and spread.count() == 5000
    assert models.training_layout(df, "key", rows_per_partition=100, spread=models.SPREAD).rdd.getNumPartitions() == 50


def test_forests_keep_the_nodes_of_their_rows():
    assert models.forest_classifier(3).getCacheNodeIds() and models.forest_regressor(3).getCacheNodeIds()


def test_runs_of_many_planes_are_counted_in_one_pass():
    row, along, across = np.array([0, 0, 0, 1, 1, 1]), np.array([0, 0, 0, 0, 0, 0]), np.array([2, 0, 1, 0, 1, 3])
    got = texture._runs(row, along, across, np.array([5, 5, 5, 5, 5, 5]), (0, 1))
    assert [x.tolist() for x in got] == [[0, 1, 1], [5, 5, 5], [3, 1, 2], [1, 1, 1]]
