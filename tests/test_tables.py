from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from trialweave import fixtures as fx
from trialweave.functions import clean
from trialweave.operators import encode, relational
from trialweave.session import scratch_path
from trialweave.sources import manifests, tables, volumes


def test_manifest_lists_files_without_reading_them(spark, sf):
    files = manifests.manifest(spark, sf, r"([^/]+)\.parquet$", ["name"], glob="*.parquet")
    assert {"region", "embeddings"} <= {r.name for r in files.collect()}
    assert "content" not in files._jdf.queryExecution().executedPlan().toString()


def test_csv_null_tokens_and_bad_values(spark):
    path = scratch_path(spark, "csv")
    text = spark.createDataFrame([("01", "NA"), ("02", "1.5"), ("03", "")], "id string, v string")
    tables.write_csv(text, path)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.DoubleType())])
    assert {(r.id, r.v) for r in tables.read_table(spark, path, schema).collect()} == {("01", None), ("02", 1.5), ("03", None)}
    bad = scratch_path(spark, "csv")
    tables.write_csv(spark.createDataFrame([("01", "x")], "id string, v string"), bad)
    with pytest.raises(PySparkException):
        tables.read_table(spark, bad, schema).collect()


def test_to_numeric_raises_on_a_bad_value(spark, sf):
    with pytest.raises(PySparkException):
        fx.registry(spark, sf).select(clean.to_numeric(F.col("pdl1_number"))).collect()


def test_filters_and_columns_reach_the_scan(spark, sf):
    features = fx.table(spark, sf, "customer").filter("c_acctbal > 10").select("c_custkey")
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(c_acctbal,10.0)" in plan and "c_name" not in plan


def test_axis_permute_twice_is_the_input(spark, sf):
    masks = fx.masks(spark, sf)
    assert volumes.axis_permute(volumes.axis_permute(masks)).exceptAll(masks).isEmpty()


def test_one_slice_series_has_no_thickness(spark):
    schema = "series string, z double, slice_location double, path string"
    rows = [("a", 1.0, 1.0, "p"), ("b", None, 2.0, "p"), ("b", None, 4.5, "q")]
    out = relational.slice_thickness(spark.createDataFrame(rows, schema)).collect()
    assert {(r.series, r.thickness) for r in out} == {("a", None), ("b", 2.5)}


def test_null_keys_pair_only_when_asked(spark):
    left = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    right = spark.createDataFrame([(None, 3), ("k", 4)], "k string, b int")
    assert left.join(right, "k").count() == 1
    assert sorted((r.a, r.b) for r in relational.join_null_safe(left, right, "k").collect()) == [(1, 3), (2, 4)]


def test_encoders_learn_from_training_rows_only(spark):
    schema = "id int, c string, v double"
    train = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0), (3, None, None)], schema)
    test = spark.createDataFrame([(4, "new", None), (5, "a", 9.0)], schema)
    model = encode.preprocessor(["v"], ["c"], scale=True).fit(train)
    seen = {r.id: r.features.toArray().tolist() for r in model.transform(test).collect()}
    assert [len(v) for v in seen.values()] == [4, 4]
    assert seen[4][0] == pytest.approx(0.0)
    assert seen[4][1:] == [0.0, 0.0, 0.0]
    assert seen[5][1:] == [0.0, 1.0, 0.0]
    other = encode.preprocessor(["v"], ["c"], scale=True).fit(train)
    assert {r.id: r.features.toArray().tolist() for r in other.transform(test).collect()} == seen


def test_constant_column_is_divided_by_one(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r.v for r in encode.MomentScaler(["v"]).fit(df).transform(df).collect()] == [0.0, 0.0]


def test_category_codes_follow_the_sorted_values(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "c")], "id int, c string")
    coded = encode.CategoryCodes(["c"]).fit(df.filter("id < 4")).transform(df)
    assert {r.id: r.c for r in coded.collect()} == {1: 1, 2: -1, 3: 0, 4: -1}


def test_boxcox_fit_finds_the_maximum(spark, sf):
    x = fx.registry(spark, sf).select((F.col("ORR") / 100 + 1).alias("x"))
    best = encode.boxcox_fit(x, "x")
    near = {
        r["lambda"]: r.log_likelihood
        for r in encode.boxcox_log_likelihoods(x, "x", [best - 0.01, best, best + 0.01]).collect()
    }
    assert near[best] == max(near.values())


def test_spread_join_equals_the_plain_join(spark):
    rows = spark.range(500).selectExpr("case when id % 3 < 2 then 'hot' else cast(id as string) end as k", "id")
    table = rows.groupBy("k").agg(F.max("id").alias("top"))
    joined = relational.join_spread(rows, table, ["k"], ["id"])
    assert joined.exceptAll(rows.join(table, "k")).isEmpty() and joined.count() == 500


def test_two_lowest_limits_before_the_shuffle(spark, sf):
    lowest = relational.two_lowest(fx.slices(spark, sf), "series", [F.col("z"), F.col("path")])
    assert "WindowGroupLimit" in lowest._jdf.queryExecution().executedPlan().toString()


def test_csv_lines_with_missing_or_extra_fields(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,v\na,1.5\nc\nd,2,f\n\"e,e\",NA\n")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.DoubleType())])
    with pytest.raises(PySparkException, match="not as many fields"):
        tables.read_table(spark, str(tmp_path), schema).collect()
    with pytest.raises(PySparkException, match="not as many fields"):
        tables.read_table(spark, str(tmp_path), schema).select("v").collect()
    kept = tables.read_table(spark, str(tmp_path), schema, bad_lines="drop").collect()
    assert {(r.id, r.v) for r in kept} == {("a", 1.5), ("e,e", None)}
    assert tables.read_table(spark, str(tmp_path), schema, bad_lines="drop").count() == 2
    assert {r.line for r in tables.bad_lines(spark, str(tmp_path), schema).collect()} == {"c", "d,2,f"}
