"""Fitted encoders and the Box-Cox fit."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.operators import encode as en
from trialweave.operators import splits
from trialweave.plans.catalog import query

CODED = ["pdl1_expression", "diagnosis", "pdl1_number"]
MEASURES = ["n_chars", "n_words", "n_distinct", "n_symbols"]
LAMBDAS = [round(-2 + 0.2 * i, 1) for i in range(21)]

IS_TRAIN = "md5(concat('7:', \"imageName\")) < 'b3'"


def train_rows(df: DataFrame) -> DataFrame:
    """About 70 of 100 rows by the hash of their id."""
    return df.filter(splits.hash_key("imageName", 7) < "b3")


@query(
    fx.with_views("registry")
    + " SELECT r.\"imageName\", "
    + ", ".join(f"coalesce(cast({c}_t.code AS int), -1) AS {c}" for c in CODED)
    + " FROM registry r "
    + " ".join(
        f"LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM "
        f"(SELECT DISTINCT {c} AS v FROM registry WHERE {c} IS NOT NULL)) {c}_t ON {c}_t.v = r.{c}"
        for c in CODED
    )
)
def category_codes(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.registry(spark, sf).select("imageName", *CODED)
    return en.CategoryCodes(CODED).fit(df).transform(df)


@query(
    fx.with_views("registry")
    + f""" , cats AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT
      coalesce(pdl1_number, 'Missing') AS v FROM registry WHERE {IS_TRAIN}))
    SELECT r."imageName", cast(c.code AS int) AS category, cast(coalesce(r.pdl1_number, 'Missing') = c.v AS int) AS entry
    FROM registry r, cats c"""
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of the training rows; the entries are listed one per row to compare them."""
    df = fx.registry(spark, sf).select("imageName", "pdl1_number")
    stages = [en.fill_text(["pdl1_number"]), *en.one_hot_stages(["pdl1_number_text"])]
    encoded = Pipeline(stages=stages).fit(train_rows(df)).transform(df)
    entries = F.posexplode(vector_to_array("pdl1_number_text_onehot")).alias("category", "entry")
    return encoded.select("imageName", entries).withColumn("entry", F.col("entry").cast("int"))


@query(
    fx.with_views("registry")
    + f""" SELECT "imageName", round(coalesce(cigarettes, (SELECT avg(cigarettes) FROM registry WHERE {IS_TRAIN})), 6)
    AS cigarettes FROM registry"""
)
def impute_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.registry(spark, sf).select("imageName", "cigarettes")
    imputed = en.impute_mean(df, ["cigarettes"], fitted_on=train_rows(df))
    return imputed.select("imageName", F.round("cigarettes", 6).alias("cigarettes"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", coalesce(pdl1_number, 'missing') AS pdl1_number,
    coalesce(cast(smoker AS VARCHAR), 'missing') AS smoker FROM registry"""
)
def impute_constant(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.registry(spark, sf).select("imageName", "pdl1_number", "smoker")
    filled = en.fill_text(["pdl1_number", "smoker"], "missing").transform(df)
    return filled.select("imageName", F.col("pdl1_number_text").alias("pdl1_number"), F.col("smoker_text").alias("smoker"))


@query(
    fx.with_views("features")
    + " SELECT \"imageName\", "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM features)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM features), 6) AS {c}"
        for c in MEASURES
    )
    + " FROM features"
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.features(spark, sf).select("imageName", *MEASURES)
    scaled = en.MomentScaler(MEASURES).fit(df).transform(df)
    return scaled.select("imageName", *[F.round(c, 6).alias(c) for c in MEASURES])


PIPELINE_SQL = (
    fx.with_views("features")
    + f""" , train AS (SELECT * FROM features WHERE {IS_TRAIN}), m AS (SELECT """
    + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in MEASURES)
    + """, list_sort(list(DISTINCT lang)) AS langs, list_sort(list(DISTINCT source)) AS sources FROM train)
    SELECT "imageName", list_concat(["""
    + ", ".join(f"round(({c} - a_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 6)" for c in MEASURES)
    + """], list_concat(list_transform(langs, lambda x: (x = lang)::DOUBLE), list_transform(sources, lambda x: (x = source)::DOUBLE))) AS features
    FROM features, m"""
)


@query(PIPELINE_SQL)
def column_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.features(spark, sf)
    model = en.preprocessor(MEASURES, ["lang", "source"], scale=True).fit(train_rows(df))
    rounded = F.transform(vector_to_array("features"), lambda x: F.round(x, 6) + F.lit(0.0))
    return model.transform(df).select("imageName", rounded.alias("features"))


@query(
    fx.with_views("registry")
    + """ , grid AS (SELECT unnest(range(21)) AS i), x AS (SELECT "ORR" / 100 + 1 AS x FROM registry),
    t AS (SELECT round(-2 + 0.2::DOUBLE * i, 1) AS lam, x, CASE WHEN i = 10 THEN ln(x)
      ELSE pow(x, round(-2 + 0.2::DOUBLE * i, 1)) / round(-2 + 0.2::DOUBLE * i, 1) END AS y FROM grid, x)
    SELECT lam AS "lambda", round((lam - 1) * sum(ln(x)) - count(*) / 2 * ln(var_pop(y)), 3) AS log_likelihood
    FROM t GROUP BY lam ORDER BY log_likelihood DESC LIMIT 1"""
)
def boxcox_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Best grid point of the Box-Cox likelihood over the shifted response."""
    x = fx.registry(spark, sf).select((F.col("ORR") / 100 + 1).alias("x"))
    points = en.boxcox_log_likelihoods(x, "x", LAMBDAS)
    best = points.orderBy(F.desc("log_likelihood")).limit(1)
    return best.select("lambda", F.round("log_likelihood", 3).alias("log_likelihood"))


@query(
    fx.with_views("registry")
    + """ SELECT "imageName", coalesce(pdl1_number, 'Missing') AS pdl1_number_text,
    coalesce(pdl1_expression, 'Missing') AS pdl1_expression_text FROM registry"""
)
def table_function(spark: SparkSession, sf: str) -> DataFrame:
    """A user function over a table as a pipeline stage."""
    df = fx.registry(spark, sf).select("imageName", "pdl1_number", "pdl1_expression")
    filled = Pipeline(stages=[en.fill_text(["pdl1_number", "pdl1_expression"])]).fit(df).transform(df)
    return filled.drop("pdl1_number", "pdl1_expression")
