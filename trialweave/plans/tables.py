"""Scans, manifests and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from trialweave import fixtures as fx
from trialweave.plans.catalog import query
from trialweave.session import scratch_path
from trialweave.sources import manifests as mf
from trialweave.sources import tables as tb
from trialweave.sources import volumes as vol

CUSTOMER = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customer-csv")
    tb.write_csv(fx.table(spark, sf, "customer"), path)
    return tb.read_table(spark, path, CUSTOMER)


@query(fx.with_views("registry") + " SELECT * FROM registry")
def scan_registry(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "registry")
    fx.registry(spark, sf).write.parquet(path)
    return tb.read_registry(spark, path)


@query(fx.with_views("features") + ' SELECT * REPLACE (round("ORR", 6) AS "ORR") FROM features')
def scan_features(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "features")
    tb.write_features(fx.features(spark, sf), path)
    return tb.read_features(spark, path).withColumn("ORR", F.round("ORR", 6))


@query(
    fx.with_views("paths")
    + """ SELECT path, split_part(path, '/', 2) AS pid, split_part(path, '/', 3) AS scan_date,
    split_part(path, '/', 4) AS name FROM paths"""
)
def scan_manifest(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.paths(spark, sf).select("path")
    return mf.parse_paths(files, r"^ct/([^/]+)/([^/]+)/([^/]+)$", ["pid", "scan_date", "name"])


@query(
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS status, count(*) AS n_rows
    FROM orders GROUP BY ALL"""
)
def scan_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A real tree month=/status= in the scratch folder is listed in tasks; hidden files and marks are skipped, the files that are left are read."""
    root = scratch_path(spark, "orders-tree")
    orders = fx.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    orders.write.partitionBy("month", "status").parquet(root)
    files = mf.manifest(spark, root, r"/month=([^/]+)/status=([^/]+)/[^/]+$", ["month", "status"], tasks=16)
    files = mf.with_suffix(mf.skip_hidden(files), ".parquet")
    counted = spark.read.parquet(root).groupBy("month", "status").agg(F.count("*").alias("n_rows"))
    return files.select("month", "status").distinct().join(counted.withColumn("month", F.col("month").cast("string")), ["month", "status"])


@query(fx.with_views("paths") + " SELECT path, name FROM paths WHERE name NOT LIKE '.%'")
def manifest_skip_hidden(spark: SparkSession, sf: str) -> DataFrame:
    return mf.skip_hidden(fx.paths(spark, sf).select("path", "name"))


@query(
    fx.with_views("paths", "mask_paths")
    + """ SELECT path FROM (SELECT path FROM paths UNION ALL SELECT path FROM mask_paths)
    WHERE path LIKE '%.dcm'"""
)
def manifest_suffix_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.paths(spark, sf).select("path").unionByName(fx.mask_paths(spark, sf).select("path"))
    return mf.with_suffix(files, ".dcm", "path")


@query(fx.with_views("paths") + " SELECT path, pid, scan_date FROM paths WHERE NOT is_done")
def manifest_skip_done(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.paths(spark, sf)
    done = files.filter("is_done").select("path")
    return mf.pending(files.select("path", "pid", "scan_date"), done, ["path"])


@query(
    """SELECT cast(vec_id AS string) AS image_name, cast(pos // 16 AS int) AS z, cast((pos // 4) % 4 AS int) AS y,
    cast(pos % 4 AS int) AS x, cast(floor(cast(v AS double) * 1000) AS bigint) AS "value"
    FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS pos FROM embeddings)"""
)
def scan_voxels(spark: SparkSession, sf: str) -> DataFrame:
    return vol.explode_volume(fx.volumes(spark, sf), "pixels", height=4, width=4)


@query(fx.with_views("registry") + """ SELECT "imageName", "set", "Group", "ORR", cigarettes FROM registry""")
def sink_csv(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["imageName", "set", "Group", "ORR", "cigarettes"]
    path = scratch_path(spark, "selected-csv")
    tb.write_csv(fx.registry(spark, sf).select(columns), path)
    schema = T.StructType([f for f in tb.REGISTRY_SCHEMA.fields if f.name in columns])
    return tb.read_table(spark, path, schema)


@query(fx.with_views("features") + """ SELECT "imageName", n_chars, n_words, n_distinct, n_symbols FROM features""")
def sink_features(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "features-out")
    tb.write_features(fx.features(spark, sf).select("imageName", "n_chars", "n_words", "n_distinct", "n_symbols"), path)
    return tb.read_features(spark, path)


@query(fx.with_views("voxels") + " SELECT * FROM voxels")
def sink_volumes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "volumes")
    vol.write_volumes(fx.voxels(spark, sf), path)
    return vol.read_volumes(spark, path)
