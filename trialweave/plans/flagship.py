"""The whole path as one query: features, fold split, encoders, forest, scores, evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.operators import encode, evaluate, explain, models, splits
from trialweave.plans.catalog import query
from trialweave.session import cut_lineage

NUMERIC = ["n_chars", "n_words", "n_distinct", "n_symbols"]
CATEGORICAL = ["lang", "source"]


def train_test(spark: SparkSession, folder: str, spread: int = 1) -> tuple[DataFrame, DataFrame]:
    """Labelled document features, about 70 of 100 rows for training by the hash of the id, these in `spread` partitions at least where they are enough.

    The measures are taken from the texts once; fitting reads the written table many times.
    """
    df = cut_lineage(fx.features(spark, folder).filter(F.col("label").isNotNull()))
    is_train = F.md5(F.concat(F.lit("7:"), "imageName")) < "b3"
    return models.training_layout(df.filter(is_train), "imageName", spread=spread), df.filter(~is_train)


def held_out_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion cells of the held-out rows, each with the AUC of the scores."""
    train, test = train_test(spark, folder, models.SPREAD)
    stages = [encode.preprocessor(NUMERIC, CATEGORICAL), models.forest_classifier(30, seed=42)]
    model = Pipeline(stages=stages).fit(train)
    scores = models.score_table(model, test, ["imageName", "label"])
    auc = evaluate.roc_auc(scores, []).first()[0]
    return evaluate.confusion_matrix(scores, [], "prediction").withColumn("auc", F.lit(auc))


CLINICAL = ["age", "cigarettes", "cycles"]
CLINICAL_CATEGORIES = ["sex", "pdl1_expression", "diagnosis"]
SELECT_ABOVE = 4

FLOW_SQL = fx.with_views("registry", "features") + f""" SELECT "imageName", lower(r."set") AS "set", r."Group" AS label, true AS probability_valid,
    {SELECT_ABOVE - 1} AS n_selected, true AS cells_add_up FROM registry r JOIN features USING ("imageName")
    WHERE r."Group" IS NOT NULL AND lower(r."set") = 'lungmate-002'"""


@query(FLOW_SQL)
def cohort_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Registry and image features to a held-out cohort's scores: features are ranked on the training cohorts only, those above the
    n-th largest importance join the clinical columns, and encoders and forest are fitted on the same cohorts."""
    train_sets, val_sets = splits.COHORT_SPLITS["19_2"]
    registry = fx.registry(spark, folder).withColumn("set", F.lower("set")).filter(F.col("Group").isNotNull())
    images = fx.features(spark, folder).select("imageName", *NUMERIC)
    cohort = cut_lineage(registry.join(images, "imageName").withColumn("label", F.col("Group").cast("int")))
    train, _ = splits.split_by_set(cohort, train_sets, val_sets)
    ranked = explain.rank_features(train, NUMERIC, "label", "imageName", trees=100, seed=21)
    chosen = explain.select_features_by(cohort.select("imageName", *NUMERIC), ranked, SELECT_ABOVE, ["imageName"])
    selected = [c for c in chosen.columns if c != "imageName"]
    table = cohort.drop(*NUMERIC).join(chosen, "imageName")
    train, val = splits.split_by_set(table, train_sets, val_sets)
    train = models.training_layout(train, "imageName", spread=models.SPREAD)
    stages = [encode.preprocessor([*CLINICAL, *selected], CLINICAL_CATEGORIES), models.InParts(models.forest_classifier(100, seed=42))]
    scores = cut_lineage(models.score_table(Pipeline(stages=stages).fit(train), val, ["imageName", "set", "label"]))
    cells = evaluate.confusion_matrix(scores, [], "prediction").agg(F.sum("count")).first()[0]
    return scores.select(
        "imageName", "set", "label", F.col("prob").between(0.0, 1.0).alias("probability_valid"),
        F.lit(len(selected)).alias("n_selected"), F.lit(cells == scores.count()).alias("cells_add_up"),
    )
