"""Projections, filters, sorts, top-k and unions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.operators import relational as rel
from trialweave.plans.catalog import query

TRIALS = ["LungMate-009", "LungMate-002", "LungMate-001"]
IMPORTANCE_CUT = 0.0005


@query(fx.with_views("registry") + """ SELECT "imageName", "set", "Group", "ORR", age, sex FROM registry""")
def project_columns(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).select("imageName", "set", "Group", "ORR", "age", "sex")


@query(
    fx.with_views("registry")
    + """ SELECT * EXCLUDE (diagnosis, cycles), diagnosis AS pathological_diagnosis, cycles AS treatment_cycles
    FROM registry"""
)
def rename_columns(spark: SparkSession, sf: str) -> DataFrame:
    names = {"diagnosis": "pathological_diagnosis", "cycles": "treatment_cycles", "not_there": "ignored"}
    return fx.registry(spark, sf).withColumnsRenamed(names)


@query(fx.with_views("registry") + """ SELECT "Group", "imageName", * EXCLUDE ("Group", "imageName") FROM registry""")
def columns_to_front(spark: SparkSession, sf: str) -> DataFrame:
    return rel.to_front(fx.registry(spark, sf), ["Group", "imageName"])


@query(
    fx.with_views("features") + """ SELECT n_chars, n_words, n_distinct, n_symbols, lang, source FROM features"""
)
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    return fx.features(spark, sf).drop("label", *rel.NON_FEATURES)


@query(fx.with_views("features") + """ SELECT "imageName", n_distinct, n_symbols, lang, source FROM features""")
def drop_column_range(spark: SparkSession, sf: str) -> DataFrame:
    return rel.drop_range(fx.features(spark, sf).drop("ORR"), 1, "n_words")


@query(
    fx.with_views("features")
    + """ SELECT feature, count(*) AS n_values FROM (
      UNPIVOT (SELECT n_chars, n_words, n_distinct, n_symbols FROM features)
      ON n_chars, n_words, n_distinct, n_symbols INTO NAME feature VALUE v) GROUP BY feature"""
)
def feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.features(spark, sf)
    names = rel.feature_columns(df.schema, ["lang", "source", "label", *rel.NON_FEATURES])
    long = df.unpivot([], names, "feature", "v")
    return long.groupBy("feature").agg(F.count("v").alias("n_values"))


@query(fx.with_views("features") + """ SELECT "imageName", n_symbols, n_distinct FROM features""")
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    top = ["n_symbols", "n_distinct"]
    return fx.features(spark, sf).select("imageName", *top)


@query(
    fx.with_views("paths") + """ SELECT split_part(name, '.', 1) AS "imageName", pid, scan_date, path FROM paths"""
)
def prepend_constant_key(spark: SparkSession, sf: str) -> DataFrame:
    key = F.substring_index("name", ".", 1).alias("imageName")
    return fx.paths(spark, sf).select(key, "pid", "scan_date", "path")


@query(
    fx.with_views("registry")
    + """ SELECT * FROM registry WHERE "set" IN ('LungMate-009', 'LungMate-002', 'LungMate-001')"""
)
def filter_isin(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).filter(F.col("set").isin(TRIALS))


@query(fx.with_views("registry") + """ SELECT * FROM registry WHERE "set" = 'LungMate-009'""")
def filter_equals(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).filter(F.col("set") == "LungMate-009")


@query(fx.with_views("registry") + """ SELECT * FROM registry WHERE "Group" IS NOT NULL""")
def filter_label_present(spark: SparkSession, sf: str) -> DataFrame:
    return fx.registry(spark, sf).filter(F.col("Group").isNotNull())


@query(fx.with_views("importances") + f" SELECT feature, importance FROM importances WHERE importance > {IMPORTANCE_CUT}")
def filter_above(spark: SparkSession, sf: str) -> DataFrame:
    return fx.importances(spark, sf).filter(F.col("importance") > IMPORTANCE_CUT)


@query(fx.with_views("importances") + " SELECT feature, importance FROM importances ORDER BY importance DESC, feature")
def sort_desc(spark: SparkSession, sf: str) -> DataFrame:
    return fx.importances(spark, sf).orderBy(F.desc("importance"), F.asc("feature"))


@query(fx.with_views("importances") + " SELECT feature, importance FROM importances ORDER BY importance, feature")
def sort_asc(spark: SparkSession, sf: str) -> DataFrame:
    return fx.importances(spark, sf).orderBy(F.asc("importance"), F.asc("feature"))


@query(
    fx.with_views("importances")
    + " SELECT feature, importance FROM importances ORDER BY importance DESC, feature LIMIT 20"
)
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    return rel.top_k(fx.importances(spark, sf), "importance", "feature", 20)


@query(
    fx.with_views("importances")
    + """ SELECT feature, importance FROM importances WHERE importance > (
      SELECT min(importance) FROM (SELECT importance FROM importances ORDER BY importance DESC LIMIT 30))"""
)
def above_nth_largest(spark: SparkSession, sf: str) -> DataFrame:
    return rel.above_nth_largest(fx.importances(spark, sf), "importance", 30)


@query(
    """SELECT p_name AS feature, cast(max(p_size) AS int) AS ranking FROM part GROUP BY p_name
    HAVING max(p_size) < 50"""
)
def rank_below(spark: SparkSession, sf: str) -> DataFrame:
    ranked = fx.table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.max("p_size").alias("ranking"))
    return ranked.filter(F.col("ranking") < 50)


@query(
    fx.with_views("features")
    + """ SELECT "imageName", n_chars, n_words, NULL::DOUBLE AS n_symbols FROM features
    UNION ALL SELECT "imageName", NULL, n_words, n_symbols FROM features"""
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.features(spark, sf)
    left, right = df.select("imageName", "n_chars", "n_words"), df.select("n_symbols", "n_words", "imageName")
    return left.unionByName(right, allowMissingColumns=True)


@query(fx.with_views("scored") + " SELECT id, label, model, prob FROM scored")
def union_folds(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.scored(spark, sf)
    folds = [df.filter(F.col("model") == m) for m in fx.SCORES]
    return folds[0].unionByName(folds[1]).unionByName(folds[2])
