"""Training, tuning, scoring and explanation on the document features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.functions import transforms as tr
from trialweave.operators import encode, evaluate, explain, models, splits
from trialweave.plans.catalog import query
from trialweave.plans.flagship import CATEGORICAL, NUMERIC, train_test
from trialweave.session import cut_lineage, scratch_path

KEEP = ["imageName", "label"]
#: Rounds of the boosted models, as many as the reference fits by default.
BOOSTING_ROUNDS = 100

SPLIT_SQL = fx.with_views("features") + """ , labelled AS (SELECT *, md5('7:' || "imageName") < 'b3' AS is_train FROM features WHERE label IS NOT NULL),
    train AS (SELECT * FROM labelled WHERE is_train), test AS (SELECT * FROM labelled WHERE NOT is_train)"""

# Scores differ between learners; what is certain is that every held-out row has one, and how good they are.
SCORES_SQL = SPLIT_SQL + """ SELECT "imageName", label, true AS probability_valid, true AS class_matches, true AS auc_above_floor FROM test"""
AUC_FLOOR = 0.85
#: Held-out rows of the rarer class from which on an AUC is held to the floor itself.
FIRM_ROWS = 20


def _auc_floor(scores: DataFrame) -> float:
    """The floor; where a class has few held-out rows, two standard errors (Hanley and McNeil) of an AUC at the floor below it, and chance at least."""
    a, b = scores.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if min(a, b) >= FIRM_ROWS or not a * b:
        return AUC_FLOOR
    area = AUC_FLOOR
    one, two = area / (2 - area), 2 * area * area / (1 + area)
    variance = (area * (1 - area) + (a - 1) * (one - area**2) + (b - 1) * (two - area**2)) / (a * b)
    return max(0.5, area - 2 * variance**0.5)


def _checked(scores: DataFrame, keep: list[str] = KEEP) -> DataFrame:
    """Each scored row with what holds for any probability classifier, and whether the AUC reaches its floor."""
    scores = cut_lineage(scores)
    auc = evaluate.roc_auc(scores, []).first()[0]
    return scores.select(
        *keep,
        F.col("prob").between(0.0, 1.0).alias("probability_valid"),
        (F.col("prediction") == (F.col("prob") > 0.5).cast("int")).alias("class_matches"),
        F.lit(bool(auc >= _auc_floor(scores))).alias("auc_above_floor"),
    )


def _fit_and_score(spark: SparkSession, sf: str, estimator, scale: bool = False, spread: int = 1) -> DataFrame:
    train, test = train_test(spark, sf, spread)
    model = Pipeline(stages=[encode.preprocessor(NUMERIC, CATEGORICAL, scale), estimator]).fit(train)
    return models.score_table(model, test, KEEP)


REGRESSION_SQL = SPLIT_SQL + """ SELECT "imageName", round(ln("ORR" / 100 + 2), 9) AS y, true AS in_range, true AS explains FROM test"""


def _regression(spark: SparkSession, sf: str, estimator, spread: int = 1) -> DataFrame:
    """Predictions of the transformed response; n_symbols stays out, since the response is made of it.

    in_range: no prediction is farther from the training responses than they are from each other. explains: the squared
    errors are below those of the mean.
    """
    train, test = (
        df.withColumn("y", tr.log1p_target(F.col("ORR"))) for df in train_test(spark, sf, spread)
    )
    numeric = ["n_chars", "n_words", "n_distinct"]
    model = Pipeline(stages=[encode.preprocessor(numeric, CATEGORICAL), estimator]).fit(train)
    scored = cut_lineage(model.transform(test).select("imageName", "y", F.col("prediction").alias("y_pred")))
    low, high = train.agg(F.min("y"), F.max("y")).first()
    error, spread = scored.agg(F.avg(F.pow(F.col("y") - F.col("y_pred"), F.lit(2))), F.var_pop("y")).first()
    near = F.col("y_pred").between(low - (high - low), high + (high - low))
    return scored.select("imageName", F.round("y", 9).alias("y"), near.alias("in_range"), F.lit(bool(error < spread)).alias("explains"))


def _folded(train: DataFrame, k: int) -> DataFrame:
    return cut_lineage(models.training_layout(splits.stratified_folds(train, "label", "imageName", k=k, seed=42), "imageName"))


def _encoded(spark: SparkSession, sf: str, scale: bool = False) -> tuple[DataFrame, DataFrame, int]:
    train, test = train_test(spark, sf)
    encoder, width = models.encoded(NUMERIC, CATEGORICAL, train, scale)
    return cut_lineage(encoder.transform(train)), encoder.transform(test), width


@query(SCORES_SQL)
def rf_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(_fit_and_score(spark, sf, models.InParts(models.forest_classifier(100, seed=42)), spread=models.SPREAD))


@query(REGRESSION_SQL)
def rf_regress(spark: SparkSession, sf: str) -> DataFrame:
    return _regression(spark, sf, models.InParts(models.forest_regressor(100, seed=42)), models.SPREAD)


@query(SCORES_SQL)
def gbt_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(_fit_and_score(spark, sf, models.boosted_classifier(rounds=BOOSTING_ROUNDS)))


@query(REGRESSION_SQL)
def gbt_regress(spark: SparkSession, sf: str) -> DataFrame:
    return _regression(spark, sf, models.boosted_regressor(rounds=BOOSTING_ROUNDS))


@query(SCORES_SQL)
def gbt_classify_sampled(spark: SparkSession, sf: str) -> DataFrame:
    train, test = train_test(spark, sf)
    pipeline = models.sampled_boosting(
        NUMERIC, CATEGORICAL, maxIter=BOOSTING_ROUNDS, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=5, seed=42,
        **models.with_depth({"leaves": 31}),
    )
    return _checked(models.score_table(pipeline.fit(train), test, KEEP))


@query(SCORES_SQL)
def gbt_classify_target_encoded(spark: SparkSession, sf: str) -> DataFrame:
    train, test = train_test(spark, sf)
    pipeline = models.target_encoded_boosting(NUMERIC, CATEGORICAL, maxIter=BOOSTING_ROUNDS, maxDepth=6, stepSize=0.05, seed=42)
    return _checked(models.score_table(pipeline.fit(train), test, KEEP))


SVM_SQL = SPLIT_SQL + """ SELECT "imageName", label, kernel, true AS probability_valid, true AS class_matches, true AS auc_above_floor
    FROM test, (VALUES ('linear'), ('rbf')) AS k(kernel)"""


@query(SVM_SQL)
def svm_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Both kernels: the linear one and the rbf approximation, with calibrated probabilities."""
    train, test, _ = _encoded(spark, sf, scale=True)
    train = _folded(train, 3)
    checked = []
    for kernel in ("linear", "rbf"):
        scores = models.score_table(models.svm_with_probability(train, "fold", kernel, iterations=25), test, KEEP)
        checked.append(_checked(scores).withColumn("kernel", F.lit(kernel)))
    return checked[0].unionByName(checked[1])


@query(SCORES_SQL)
def mlp_classify(spark: SparkSession, sf: str) -> DataFrame:
    train, test, width = _encoded(spark, sf, scale=True)
    train = models.training_layout(train, "imageName", spread=models.SPREAD)
    return _checked(models.score_table(models.network(width, iterations=40).fit(train), test, KEEP))


WEIGHTED_SQL = SPLIT_SQL + """ , a AS (SELECT label, lang, count(*) AS n FROM train GROUP BY ALL), b AS (SELECT label, lang, count(*) AS m FROM test GROUP BY ALL),
    w AS (SELECT avg(least(greatest(coalesce(m, 0) / n, 0.5), 2.0)) AS mean_weight FROM train JOIN a USING (label, lang) LEFT JOIN b USING (label, lang))
    SELECT "imageName", label, true AS probability_valid, true AS class_matches, true AS auc_above_floor, round(mean_weight, 6) AS mean_weight FROM test, w"""


@query(WEIGHTED_SQL)
def weighted_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees on training rows weighted towards the label and language mix of the held-out rows."""
    train, test = train_test(spark, sf)
    weighted = cut_lineage(models.training_layout(splits.reweight(train, test, ["label", "lang"]), "imageName"))
    boosted = models.boosted_classifier(rounds=BOOSTING_ROUNDS, weightCol="weight")
    model = Pipeline(stages=[encode.preprocessor(NUMERIC, CATEGORICAL), boosted]).fit(weighted)
    mean = weighted.agg(F.round(F.avg("weight"), 6)).first()[0]
    return _checked(models.score_table(model, test, KEEP)).withColumn("mean_weight", F.lit(mean))


CLASS_WEIGHT_SQL = SPLIT_SQL + """ , w AS (SELECT round(count(*) FILTER (label = 0) / count(*) FILTER (label = 1), 6) AS positive_weight FROM train)
    SELECT "imageName", label, true AS probability_valid, true AS class_matches, true AS auc_above_floor, positive_weight FROM test, w"""


@query(CLASS_WEIGHT_SQL)
def class_weighted_fit(spark: SparkSession, sf: str) -> DataFrame:
    train, test = train_test(spark, sf)
    weighted = cut_lineage(models.with_class_weight(train))
    boosted = models.boosted_classifier(rounds=BOOSTING_ROUNDS, weightCol="class_weight")
    model = Pipeline(stages=[encode.preprocessor(NUMERIC, CATEGORICAL), boosted]).fit(weighted)
    ratio = weighted.filter("label = 1").agg(F.round(F.max("class_weight"), 6)).first()[0]
    return _checked(models.score_table(model, test, KEEP)).withColumn("positive_weight", F.lit(ratio))


@query(SCORES_SQL)
def score_table(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(_fit_and_score(spark, sf, models.forest_classifier(30, seed=21), spread=models.SPREAD))


@query(SPLIT_SQL + """ SELECT "imageName", label, true AS same FROM test""")
def save_model(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the reloaded model scores each row as the fitted one did."""
    train, test = train_test(spark, sf)
    stages = [encode.preprocessor(NUMERIC, CATEGORICAL), models.forest_classifier(10, seed=42)]
    model = Pipeline(stages=stages).fit(train)
    path = scratch_path(spark, "model")
    models.save_model(model, path)
    again = models.score_table(models.load_model(path), test, ["imageName"])
    before = models.score_table(model, test, KEEP)
    return before.join(again.select("imageName", F.col("prob").alias("prob_reloaded")), "imageName").select(
        *KEEP, F.col("prob").eqNullSafe(F.col("prob_reloaded")).alias("same")
    )


@query("SELECT * FROM (VALUES ('n_chars'), ('n_words'), ('n_distinct'), ('n_symbols')) AS t(feature), (SELECT true AS valid, true AS adds_up_to_one)")
def select_by_importance(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = train_test(spark, sf)
    ranked = cut_lineage(explain.rank_features(train, NUMERIC, "label", "imageName", trees=100, seed=21))
    total = ranked.agg(F.sum("importance")).first()[0]
    return ranked.select("feature", F.col("importance").between(0.0, 1.0).alias("valid"), F.lit(abs(total - 1) < 1e-9).alias("adds_up_to_one"))


@query(
    "SELECT *, feature <> 'noise' AS may_be_kept FROM (VALUES ('n_chars'), ('n_words'), ('n_distinct'), ('n_symbols'), ('noise')) AS t(feature), (SELECT true AS hits_valid)"
)
def select_by_shadow(spark: SparkSession, sf: str) -> DataFrame:
    """The measures and one column of pure noise, which is not kept."""
    train, _ = train_test(spark, sf)
    noise = F.conv(F.substring(F.md5("imageName"), 1, 6), 16, 10).cast("double")
    chosen = explain.shadow_select(train.withColumn("noise", noise), [*NUMERIC, "noise"], "label", "imageName", rounds=40)
    return chosen.select(
        "feature", F.col("hits").between(0, F.col("rounds")).alias("hits_valid"), ((F.col("feature") != "noise") | (F.col("ranking") == 1)).alias("may_be_kept")
    )


GRID_SQL = f"""SELECT (p.point)::INTEGER AS point, p.params, f.fold::INTEGER AS fold, true AS metric_valid, true AS best_is_first_largest
    FROM (SELECT row_number() OVER (ORDER BY i, d) - 1 AS point, '{{''maxIter'': ' || i || ', ''maxDepth'': ' || d || '}}' AS params
      FROM (VALUES (5), (10)) AS a(i), (VALUES (2), (3)) AS b(d)) p, (SELECT unnest(range(5)) AS fold) f"""


@query(GRID_SQL)
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every point of a small grid on five folds, and the refit of the best one."""
    train, _ = train_test(spark, sf)
    folded = _folded(train, 5)
    points = models.grid_points({"maxIter": [5, 10], "maxDepth": [2, 3]})
    encoder = encode.preprocessor(NUMERIC, CATEGORICAL)

    def build(point: dict) -> GBTClassifier:
        return GBTClassifier(seed=42, **point)

    table, best = models.tune(encoder, build, points, folded, "auc", "fold")
    models.fit_best(encoder, build, best, train)
    table = cut_lineage(table)
    means = {r.point: r.m for r in table.groupBy("point").agg(F.avg("metric").alias("m")).collect()}
    first = min(p for p, m in means.items() if m >= max(means.values()) - 1e-12)
    right = F.col("best") == (F.col("point") == first)
    return table.select("point", "params", "fold", F.col("metric").between(0.0, 1.0).alias("metric_valid"), right.alias("best_is_first_largest"))


OOF_SQL = SPLIT_SQL + """ SELECT "imageName", label,
      cast((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || "imageName"), "imageName") - 1) % 5 AS int) AS fold,
      true AS probability_valid, true AS class_matches, true AS auc_above_floor FROM train"""


@query(OOF_SQL)
def cross_val_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(_out_of_fold(spark, sf, k=5, trees=30), [*KEEP, "fold"])


def _out_of_fold(spark: SparkSession, sf: str, k: int, trees: int) -> DataFrame:
    train, _ = train_test(spark, sf)
    folded = models.training_layout(_folded(train, k), "imageName", spread=models.SPREAD)
    pipeline = Pipeline(
        stages=[encode.preprocessor(NUMERIC, CATEGORICAL), models.forest_classifier(trees, seed=42)]
    )
    return models.oof_predict(pipeline, folded, "fold", KEEP)


@query("SELECT (2 * (i + 1))::INTEGER AS iteration, true AS losses_positive, true AS rates_valid, true AS objective_falls FROM (SELECT unnest(range(20)) AS i)")
def train_history(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty evaluations, one after every two of forty iterations."""
    train, test, width = _encoded(spark, sf, scale=True)
    train = models.training_layout(train, "imageName", spread=models.SPREAD)
    table = models.train_history(train, cut_lineage(test), width, stages=20, iterations=2)
    ends = table.agg(F.max_by("objective", "iteration"), F.min_by("objective", "iteration")).first()
    rates = F.lit(True)
    for c in ("train_accuracy", "test_accuracy", "test_auc"):
        rates = rates & F.col(c).between(0.0, 1.0)
    return table.select("iteration", (F.col("train_loss") > 0).alias("losses_positive"), rates.alias("rates_valid"), F.lit(ends[0] < ends[1]).alias("objective_falls"))


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    train, test = train_test(spark, sf)
    encoder = encode.preprocessor(NUMERIC, []).fit(train)
    model = models.boosted_classifier(rounds=BOOSTING_ROUNDS).fit(encoder.transform(train))
    held_out = model.transform(encoder.transform(test))
    margin = vector_to_array("rawPrediction")[1].alias("margin")
    values = explain.shap_values(model, held_out, NUMERIC, "imageName")
    return values.join(held_out.select("imageName", margin), "imageName")


@query(SPLIT_SQL + """ SELECT "imageName", 4::BIGINT AS n_features, true AS adds_up FROM test""")
def shap_values(spark: SparkSession, sf: str) -> DataFrame:
    """Attributions of the held-out rows: per row one for each feature, which with the base add up to the margin."""
    rest = F.abs(F.sum("attribution") + F.first("base") - F.first("margin")) < 1e-6
    return _explained(spark, sf).groupBy("imageName").agg(F.count("feature").alias("n_features"), rest.alias("adds_up"))


SUMMARY_SQL = fx.with_views("importances") + """ , v AS (SELECT split_part(feature, '#', 1) AS feature,
      importance * (CASE WHEN cast(split_part(feature, '#', 2) AS int) % 2 = 0 THEN 1000 ELSE -1000 END) AS attribution
      FROM importances)
    SELECT feature, round(avg(abs(attribution)), 9) AS importance FROM v GROUP BY feature
    ORDER BY avg(abs(attribution)) DESC, feature LIMIT 20"""


@query(SUMMARY_SQL)
def shap_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute attribution per feature on signed importance values."""
    number = F.substring_index("feature", "#", -1).cast("int")
    signed = F.col("importance") * F.when(number % 2 == 0, 1000).otherwise(-1000)
    values = fx.importances(spark, sf).select(F.substring_index("feature", "#", 1).alias("feature"), signed.alias("attribution"))
    return explain.shap_summary(values, 20).withColumn("importance", F.round("importance", 9))
