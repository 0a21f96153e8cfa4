"""Key joins, pairing and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.operators import relational as rel
from trialweave.operators import splits
from trialweave.plans.catalog import query
from trialweave.sources import manifests as mf

IN_TRIAL = "\"set\" IN ('LungMate-009', 'LungMate-002', 'LungMate-001')"

# Training (009) and validation (001, 002) counts per label and cycles, and their bounded ratio.
WEIGHTS = """
  train AS (SELECT * FROM registry WHERE "set" = 'LungMate-009'),
  val AS (SELECT * FROM registry WHERE "set" IN ('LungMate-001', 'LungMate-002')),
  tc AS (SELECT "Group", cycles, count(*) AS n FROM train WHERE "Group" IS NOT NULL GROUP BY ALL),
  vc AS (SELECT "Group", cycles, count(*) AS n FROM val WHERE "Group" IS NOT NULL GROUP BY ALL),
  weights AS (SELECT coalesce(tc."Group", vc."Group") AS "Group", coalesce(tc.cycles, vc.cycles) AS cycles,
    coalesce(tc.n, 0) AS n_train, coalesce(vc.n, 0) AS n_val,
    CASE WHEN coalesce(tc.n, 0) = 0 THEN 2.0::DOUBLE
      ELSE least(greatest(coalesce(vc.n, 0)::DOUBLE / tc.n, 0.5::DOUBLE), 2.0::DOUBLE) END AS weight
    FROM tc FULL JOIN vc ON tc."Group" = vc."Group" AND tc.cycles = vc.cycles)"""


def cohorts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return splits.split_by_set(fx.registry(spark, sf), ["LungMate-009"], ["LungMate-001", "LungMate-002"])


@query(
    fx.with_views("registry", "features")
    + """ SELECT r."imageName", r."set", r."Group", r.age, f.n_chars, f.n_words, f.n_distinct, f.n_symbols, f.label
    FROM registry r JOIN features f ON r."imageName" = f."imageName" """
)
def join_inner_key(spark: SparkSession, sf: str) -> DataFrame:
    registry = fx.registry(spark, sf).select("imageName", "set", "Group", "age")
    features = fx.features(spark, sf).drop("ORR", "lang", "source")
    return registry.join(features, "imageName", "inner")


@query(
    fx.with_views("registry", "features")
    + f""" SELECT r."imageName", r."set", f.n_chars, f.n_symbols
    FROM (SELECT "imageName", "set" FROM registry WHERE {IN_TRIAL}) r JOIN features f ON r."imageName" = f."imageName" """
)
def join_attach_columns(spark: SparkSession, sf: str) -> DataFrame:
    cohort = fx.registry(spark, sf).filter(F.col("set").isin("LungMate-009", "LungMate-002", "LungMate-001"))
    features = fx.features(spark, sf).select("imageName", "n_chars", "n_symbols")
    return cohort.select("imageName", "set").join(features, "imageName")


@query(
    fx.with_views("registry")
    + """ , l AS (SELECT CASE WHEN "Group" IS NULL THEN NULL ELSE "imageName" END AS k, age FROM registry),
    r AS (SELECT CASE WHEN "Group" IS NULL THEN NULL ELSE "imageName" END AS k, max(cycles) AS cycles
      FROM registry GROUP BY 1)
    SELECT l.k, l.age, r.cycles FROM l JOIN r ON l.k IS NOT DISTINCT FROM r.k"""
)
def join_inner_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.registry(spark, sf).withColumn("k", F.when(F.col("Group").isNotNull(), F.col("imageName")))
    return rel.join_null_safe(rows.select("k", "age"), rows.groupBy("k").agg(F.max("cycles").alias("cycles")), "k")


@query(
    fx.with_views("paths", "mask_paths")
    + """ SELECT p.path, p.pid, p.scan_date FROM paths p
    WHERE EXISTS (SELECT 1 FROM mask_paths m WHERE m.pid = p.pid AND m.scan_date = p.scan_date)"""
)
def pair_semi(spark: SparkSession, sf: str) -> DataFrame:
    images = fx.paths(spark, sf).select("path", "pid", "scan_date")
    return mf.paired(images, fx.mask_paths(spark, sf), ["pid", "scan_date"])


@query(
    fx.with_views("paths", "mask_paths")
    + """ SELECT p.path, p.pid, p.scan_date FROM paths p
    WHERE NOT EXISTS (SELECT 1 FROM mask_paths m WHERE m.pid = p.pid AND m.scan_date = p.scan_date)"""
)
def pair_anti(spark: SparkSession, sf: str) -> DataFrame:
    images = fx.paths(spark, sf).select("path", "pid", "scan_date")
    return mf.unpaired(images, fx.mask_paths(spark, sf), ["pid", "scan_date"])


@query(
    fx.with_views("paths", "mask_paths")
    + """ SELECT p.pid, p.scan_date, p.path AS ct_path, m.path AS label_path
    FROM paths p JOIN mask_paths m ON m.pid = p.pid AND m.scan_date = p.scan_date"""
)
def pair_on_path(spark: SparkSession, sf: str) -> DataFrame:
    images = fx.paths(spark, sf).select("pid", "scan_date", F.col("path").alias("ct_path"))
    labels = fx.mask_paths(spark, sf).withColumnRenamed("path", "label_path")
    return images.join(labels, ["pid", "scan_date"])


@query(fx.with_views("registry") + "," + WEIGHTS + """ SELECT "Group", cycles, n_train, n_val FROM weights""")
def join_full_outer_fill(spark: SparkSession, sf: str) -> DataFrame:
    train, val = cohorts(spark, sf)
    return rel.aligned_counts(train, val, ["Group", "cycles"], ("n_train", "n_val"))


@query(
    fx.with_views("registry")
    + ","
    + WEIGHTS
    + """ SELECT t."imageName", coalesce(w.weight, 1.0::DOUBLE) AS weight FROM train t
    LEFT JOIN weights w ON t."Group" = w."Group" AND t.cycles = w.cycles"""
)
def join_lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    train, val = cohorts(spark, sf)
    keys = ["Group", "cycles"]
    weights = splits.target_weights(train, val, keys)
    return rel.lookup(train, weights, keys, "weight", F.lit(1.0)).select("imageName", "weight")


@query(
    fx.with_views("scored")
    + """ , one AS (SELECT id, label, prob, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', id)), id) - 1
      AS pos FROM scored WHERE model = 'a')
    SELECT f.id, f.label, cast(o.pos % 5 AS int) AS fold, round(f.prob, 9) AS prob
    FROM one o JOIN scored f ON f.id = o.id WHERE f.model = 'b'"""
)
def join_oof_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Scores that arrive fold by fold are put back on the rows they belong to."""
    scored = fx.scored(spark, sf)
    rows = splits.stratified_folds(scored.filter("model = 'a'").select("id", "label"), "label", "id")
    scores = scored.filter("model = 'b'").select("id", F.round("prob", 9).alias("prob"))
    return rows.join(scores, "id")
