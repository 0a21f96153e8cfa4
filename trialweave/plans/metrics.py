"""Evaluation tables on the score table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave import fixtures as fx
from trialweave.functions import transforms as tr
from trialweave.operators import evaluate as ev
from trialweave.operators import relational as rel
from trialweave.plans.catalog import query

SWEEP = tr.cut_values(0.1, 0.8, 20)

RANK_AUC = """ , ranked AS (SELECT grp, y, s, (rank() OVER (PARTITION BY grp ORDER BY s)
      + (count(*) OVER (PARTITION BY grp, s) - 1) / 2.0::DOUBLE) AS r FROM pairs),
    auc AS (SELECT grp, (sum(r) FILTER (WHERE y = 1) - sum(y)::DOUBLE * (sum(y) + 1) / 2)
      / (sum(y)::DOUBLE * sum(1 - y)) AS auc FROM ranked GROUP BY grp)
    SELECT grp AS {name}, round(auc, 9) AS auc FROM auc"""


def _rounded(df: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _hard(spark: SparkSession, sf: str) -> DataFrame:
    return fx.scored(spark, sf).withColumn("prediction", tr.binarize(F.col("prob"), 0.5))


@query(
    fx.with_views("scored")
    + " SELECT model, round(avg((label = cast(prob > 0.5 AS int))::int), 9) AS accuracy FROM scored GROUP BY model"
)
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.accuracy(_hard(spark, sf), ["model"], "prediction"), ["accuracy"])


@query(
    fx.with_views("scored")
    + """ SELECT model, 0.75::DOUBLE AS cut, round(avg((label = cast(prob >= 0.75 AS int))::int), 9) AS accuracy
    FROM scored GROUP BY model UNION ALL
    SELECT model, 0.5::DOUBLE, round(avg((label = cast(prob > 0.5 AS int))::int), 9) FROM scored GROUP BY model"""
)
def accuracy_at(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.scored(spark, sf)
    at_cut = ev.accuracy_at(df, ["model"], 0.75, inclusive=True).withColumn("cut", F.lit(0.75))
    above_half = ev.accuracy_at(df, ["model"], 0.5, inclusive=False).withColumn("cut", F.lit(0.5))
    return _rounded(at_cut.unionByName(above_half), ["accuracy"])


@query(
    fx.with_views("scored")
    + " , cuts(threshold) AS (VALUES "
    + ", ".join(f"({c!r}::DOUBLE)" for c in SWEEP)
    + """) SELECT model, round(threshold, 9) AS threshold,
    round(avg((label = cast(prob > threshold AS int))::int), 9) AS accuracy
    FROM scored, cuts GROUP BY model, threshold"""
)
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.threshold_sweep(fx.scored(spark, sf), ["model"], SWEEP), ["threshold", "accuracy"])


@query(
    "WITH pairs AS (SELECT event_type AS grp, cast(user_id % 2 AS int) AS y, \"value\" AS s FROM events)"
    + RANK_AUC.format(name="event_type")
)
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every event against a label from its user, per event type."""
    events = fx.table(spark, sf, "events").select(
        "event_type", (F.col("user_id") % 2).cast("int").alias("label"), F.col("value").alias("prob")
    )
    return _rounded(ev.roc_auc(events, ["event_type"]), ["auc"])


@query(
    fx.with_views("scored")
    + " , pairs AS (SELECT model AS grp, label AS y, cast(prob > 0.5 AS int) AS s FROM scored)"
    + RANK_AUC.format(name="model")
)
def roc_auc_hard(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.roc_auc(_hard(spark, sf), ["model"], "prediction"), ["auc"])


@query(
    fx.with_views("features")
    + """ , pairs AS (SELECT lang AS grp, cast(ln("ORR" / 100 + 2) > ln(2.05::DOUBLE) AS int) AS y, n_words / n_chars AS s
      FROM features)"""
    + RANK_AUC.format(name="lang")
)
def roc_auc_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking quality of a continuous prediction against the response cut on the transformed scale."""
    y = tr.binarize(tr.log1p_target(F.col("ORR")), tr.transform_cut(cut=1.05))
    df = fx.features(spark, sf).select("lang", y.alias("label"), (F.col("n_words") / F.col("n_chars")).alias("prob"))
    return _rounded(ev.roc_auc(df, ["lang"]), ["auc"])


ROC_SQL = """ , steps AS (SELECT model, prob, sum(label) AS pos, sum(1 - label) AS neg FROM picked GROUP BY ALL),
    curve AS (SELECT model, prob, sum(pos) OVER w / sum(pos) OVER t AS tpr, sum(neg) OVER w / sum(neg) OVER t AS fpr
      FROM steps WINDOW w AS (PARTITION BY model ORDER BY prob DESC ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY model))
    SELECT {model} round(prob, 9) AS threshold, round(fpr::DOUBLE, 9) AS fpr, round(tpr::DOUBLE, 9) AS tpr FROM curve
    UNION ALL SELECT {distinct} NULL, 0, 0 FROM (SELECT DISTINCT model FROM curve)"""


@query(
    fx.with_views("scored")
    + " , picked AS (SELECT 'all' AS model, prob, label FROM scored)"
    + ROC_SQL.format(model="", distinct="")
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    """One curve over the scores of all models together; roc_compare has one for each."""
    return _rounded(ev.roc_curve(fx.scored(spark, sf), []), ["threshold", "fpr", "tpr"])


@query(fx.with_views("scored") + " , picked AS (SELECT * FROM scored)" + ROC_SQL.format(model="model,", distinct="model,"))
def roc_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.roc_curve(fx.scored(spark, sf), ["model"]), ["threshold", "fpr", "tpr"])


@query(
    fx.with_views("scored")
    + """ , hard AS (SELECT model, label, cast(prob > 0.5 AS int) AS prediction FROM scored)
    SELECT m.model, y.v AS label, p.v AS prediction, count(*) FILTER (WHERE m.label = y.v AND m.prediction = p.v) AS "count"
    FROM hard m, (VALUES (0), (1)) y(v), (VALUES (0), (1)) p(v) GROUP BY ALL"""
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_matrix(_hard(spark, sf), ["model"], "prediction")


@query(
    fx.with_views("scored")
    + """ , hard AS (SELECT model, label, cast(prob > 0.5 AS int) AS prediction FROM scored),
    classes(c) AS (VALUES (0), (1)),
    cells AS (SELECT model, c, count(*) FILTER (WHERE label = c AND prediction = c) AS hit,
      count(*) FILTER (WHERE label = c) AS support, count(*) FILTER (WHERE prediction = c) AS called
      FROM hard, classes GROUP BY ALL),
    pr AS (SELECT model, c, support, coalesce(hit::DOUBLE / nullif(called, 0), 0) AS precision,
      coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall, hit FROM cells),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr),
    lines AS (SELECT model, c::VARCHAR AS "row", precision, recall, f1, support FROM f
    UNION ALL SELECT model, 'accuracy', sum(hit)::DOUBLE / sum(support), sum(hit)::DOUBLE / sum(support),
      sum(hit)::DOUBLE / sum(support), sum(support) FROM f GROUP BY model
    UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f GROUP BY model
    UNION ALL SELECT model, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support) FROM f GROUP BY model)
    SELECT model, "row", round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
      support::BIGINT AS support FROM lines"""
)
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    report = ev.classification_report(_hard(spark, sf), ["model"], "prediction")
    return _rounded(report, ["precision", "recall", "f1"])


@query(
    fx.with_views("scored")
    + """ SELECT model, round(avg(-(label * CASE WHEN prob <= 0 THEN -100 ELSE greatest(ln(prob), -100) END
      + (1 - label) * CASE WHEN 1 - prob <= 0 THEN -100 ELSE greatest(ln(1 - prob), -100) END)), 6) AS log_loss
    FROM scored GROUP BY model"""
)
def log_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.log_loss(fx.scored(spark, sf), ["model"]), ["log_loss"], 6)


@query(
    fx.with_views("importances")
    + " SELECT feature, importance FROM importances ORDER BY importance DESC, feature LIMIT 20"
)
def importance_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return rel.top_k(fx.importances(spark, sf), "importance", "feature", 20)
