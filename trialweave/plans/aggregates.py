"""Aggregations and order-dependent numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.operators import evaluate as ev
from trialweave.operators import relational as rel
from trialweave.operators import splits
from trialweave.plans.catalog import query
from trialweave.sources import manifests as mf

NUMBERS = ["age", "cigarettes", "ORR"]
MEASURES = ["n_chars", "n_words", "n_distinct", "n_symbols"]
REGISTRY_COLUMNS = [
    "imageName", "set", "Group", "ORR", "age", "sex", "smoker", "cigarettes", "pdl1_number", "pdl1_expression",
    "diagnosis", "cycles", "stage_t",
]


@query(
    fx.with_views("registry")
    + """ SELECT "set", "Group", count(*) AS "count" FROM registry WHERE "Group" IS NOT NULL GROUP BY ALL"""
)
def group_count(spark: SparkSession, sf: str) -> DataFrame:
    return rel.group_count(fx.registry(spark, sf), ["set", "Group"])


@query(
    fx.with_views("scored")
    + """ SELECT m.model, c.class, count(*) FILTER (WHERE label = c.class) AS "count"
    FROM scored m, (VALUES (0), (1)) c(class) GROUP BY ALL"""
)
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ev.class_counts(fx.scored(spark, sf), ["model"])


@query(
    fx.with_views("scored")
    + """ SELECT model, round(sum(1 - label)::DOUBLE / sum(label), 9) AS scale_pos_weight FROM scored GROUP BY model"""
)
def scale_pos_weight(spark: SparkSession, sf: str) -> DataFrame:
    ratio = ev.scale_pos_weight(fx.scored(spark, sf), ["model"])
    return ratio.withColumn("scale_pos_weight", F.round("scale_pos_weight", 9))


@query(
    fx.with_views("registry")
    + " SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER (WHERE "{c}" IS NULL) AS nulls FROM registry"""
        for c in REGISTRY_COLUMNS
    )
    + ") WHERE nulls > 0"
)
def null_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rel.null_audit(fx.registry(spark, sf))


@query(
    fx.with_views("registry")
    + " SELECT DISTINCT pdl1_number FROM registry WHERE pdl1_number IS NOT NULL ORDER BY pdl1_number"
)
def distinct_categories(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).select("pdl1_number").dropna().distinct().orderBy("pdl1_number")


@query(
    fx.with_views("registry") + " SELECT " + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in NUMBERS) + " FROM registry"
)
def column_means(spark: SparkSession, sf: str) -> DataFrame:
    means = rel.column_means(fx.registry(spark, sf), NUMBERS)
    return means.select([F.round(c, 6).alias(c) for c in NUMBERS])


@query(
    fx.with_views("features")
    + " UNION ALL ".join(
        f" SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM features"
        for c in MEASURES
    )
)
def column_moments(spark: SparkSession, sf: str) -> DataFrame:
    moments = rel.column_moments(fx.features(spark, sf), MEASURES)
    return moments.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    fx.with_views("paths")
    + """ SELECT pid, arg_min(path, (scan_date, path)) AS path, min(scan_date) AS scan_date FROM paths
    WHERE name NOT LIKE '.%' GROUP BY pid"""
)
def earliest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return mf.earliest_per_key(mf.skip_hidden(fx.paths(spark, sf)), "pid", "scan_date", "path")


@query(
    fx.with_views("slices")
    + """ SELECT series, path, slice_location,
    row_number() OVER (PARTITION BY series ORDER BY z NULLS FIRST, slice_location, path) - 1 AS slice_number FROM slices"""
)
def slice_order(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rel.slice_order(fx.slices(spark, sf))
    return ranked.select("series", "path", "slice_location", "slice_number")


@query(
    fx.with_views("slices")
    + """ , ranked AS (SELECT *, row_number() OVER (PARTITION BY series
      ORDER BY z NULLS LAST, slice_location NULLS LAST, path) AS slot FROM slices),
    gaps AS (SELECT a.series, abs(a.z - b.z) AS gz, abs(a.slice_location - b.slice_location) AS gl
      FROM ranked a JOIN ranked b ON a.series = b.series AND a.slot = 1 AND b.slot = 2)
    SELECT s.series, s.path, coalesce(gz, gl) AS thickness FROM slices s LEFT JOIN gaps g ON s.series = g.series"""
)
def slice_thickness(spark: SparkSession, sf: str) -> DataFrame:
    return rel.slice_thickness(fx.slices(spark, sf)).select("series", "path", "thickness")


@query(
    fx.with_views("scored")
    + """ SELECT id, label, cast((row_number() OVER (PARTITION BY label ORDER BY md5(concat('17:', id)), id) - 1) % 5 AS int)
    AS fold FROM scored WHERE model = 'a'"""
)
def fold_number(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.scored(spark, sf).filter("model = 'a'").select("id", "label")
    return splits.stratified_folds(rows, "label", "id", k=5, seed=17)


@query(
    fx.with_views("scored")
    + """ , steps AS (SELECT model, prob, sum(label) AS pos, sum(1 - label) AS neg FROM scored GROUP BY ALL)
    SELECT model, prob, cast(pos AS bigint) AS pos, cast(neg AS bigint) AS neg,
      cast(sum(pos) OVER w AS bigint) AS cum_pos, cast(sum(neg) OVER w AS bigint) AS cum_neg
    FROM steps WINDOW w AS (PARTITION BY model ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)"""
)
def cumulative_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ev.cumulative_counts(fx.scored(spark, sf), ["model"])
