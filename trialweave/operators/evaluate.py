"""Evaluation tables over a score table: label, prob or prediction, and columns to group by."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from trialweave.operators.ranking import running_sums
from trialweave.session import cut_lineage


def class_counts(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Rows of class 0 and class 1; a class without rows counts 0."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.count_if(F.col(label) == c).alias("count"))
            for c in (0, 1)
        ]
    )
    return df.groupBy(*by).agg(cells.alias("cells")).select(*by, F.inline("cells"))


def scale_pos_weight(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    ratio = F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))
    return df.groupBy(*by).agg(ratio.alias("scale_pos_weight"))


def _mean_equal(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def accuracy(df: DataFrame, by: list[str], prediction: str, label: str = "label") -> DataFrame:
    return df.groupBy(*by).agg(_mean_equal(F.col(label), F.col(prediction)).alias("accuracy"))


def accuracy_at(
    df: DataFrame, by: list[str], cut: float, inclusive: bool, score: str = "prob", label: str = "label"
) -> DataFrame:
    """Accuracy at one cut; inclusive predicts 1 from the cut on, otherwise only above it."""
    above = F.col(score) >= cut if inclusive else F.col(score) > cut
    return df.groupBy(*by).agg(_mean_equal(F.col(label), above.cast("int")).alias("accuracy"))


def threshold_sweep(
    df: DataFrame, by: list[str], cuts: list[float], score: str = "prob", label: str | Column = "label"
) -> DataFrame:
    """Accuracy for every cut (strictly above it counts as 1) from one aggregation over the scores."""
    target = F.col(label) if isinstance(label, str) else label
    points = F.array(
        *[
            F.struct(
                F.lit(cut).alias("threshold"),
                _mean_equal(target, (F.col(score) > F.lit(cut)).cast("int")).alias("accuracy"),
            )
            for cut in cuts
        ]
    )
    return df.groupBy(*by).agg(points.alias("points")).select(*by, F.inline("points"))


def cumulative_counts(df: DataFrame, by: list[str], score: str = "prob", label: str = "label") -> DataFrame:
    """Per distinct score, the positives and negatives at or above it; scores fall, counts rise. Rows without a score or label do not count."""
    grouped = df.dropna(subset=[score, label]).groupBy(*by, score).agg(
        F.sum(F.col(label)).cast("bigint").alias("pos"), F.sum(1 - F.col(label)).cast("bigint").alias("neg")
    )
    falling = grouped.withColumn("_falling", -F.col(score))
    return running_sums(falling, by, "_falling", {"cum_pos": "pos", "cum_neg": "neg"}).drop("_falling")


def _class_totals(df: DataFrame, by: list[str], label: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum(F.col(label)).cast("bigint").alias("total_pos"), F.sum(1 - F.col(label)).cast("bigint").alias("total_neg")
    )


def roc_auc(df: DataFrame, by: list[str], score: str = "prob", label: str = "label") -> DataFrame:
    """Area under the ROC curve; a positive and a negative with equal score count half.

    Exact in integers up to the last division: every score group adds the pairs of its negatives with
    the positives above it (twice) and beside it (once).
    """
    steps = cumulative_counts(df, by, score, label)
    beaten = (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(19,0)")
    twice = F.sum(F.col("neg").cast("decimal(18,0)") * beaten)
    pairs = 2 * F.sum("pos").cast("decimal(19,0)") * F.sum("neg").cast("decimal(19,0)")
    area = F.try_divide(twice.cast("double"), pairs.cast("double"))
    return steps.groupBy(*by).agg(area.alias("auc"))


def roc_curve(df: DataFrame, by: list[str], score: str = "prob", label: str = "label") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score plus the origin, whose threshold is null; as in roc_auc, rows without a score or label do not count.

    The class totals are one row per group; they are written, so that their size is known and many scores of few groups are not shuffled.
    """
    steps = cumulative_counts(df, by, score, label)
    totals = cut_lineage(_class_totals(df.dropna(subset=[score, label]), by, label))
    if by:
        of = totals.select(*[F.col(g).alias(f"_of_{g}") for g in by], "total_pos", "total_neg")
        joined = steps.join(of, reduce(and_, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in by]))
    else:
        joined = steps.withColumns(dict(zip(("total_pos", "total_neg"), map(F.lit, totals.first()))))
    points = joined.select(
        *by,
        F.col(score).alias("threshold"),
        F.try_divide("cum_neg", "total_neg").alias("fpr"),
        F.try_divide("cum_pos", "total_pos").alias("tpr"),
    )
    origin = totals.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def confusion_matrix(df: DataFrame, by: list[str], prediction: str, label: str = "label") -> DataFrame:
    """The four counts of (label, prediction); an empty cell counts 0."""
    cells = F.array(
        *[
            F.struct(
                F.lit(y).alias("label"),
                F.lit(p).alias("prediction"),
                F.count_if((F.col(label) == y) & (F.col(prediction) == p)).alias("count"),
            )
            for y in (0, 1)
            for p in (0, 1)
        ]
    )
    return df.groupBy(*by).agg(cells.alias("cells")).select(*by, F.inline("cells"))


def classification_report(df: DataFrame, by: list[str], prediction: str, label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and plain and support-weighted means."""
    cell = {
        (y, p): F.count_if((F.col(label) == y) & (F.col(prediction) == p)).cast("double")
        for y in (0, 1)
        for p in (0, 1)
    }
    counts = df.groupBy(*by).agg(*[c.alias(f"n{y}{p}") for (y, p), c in cell.items()])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    total = F.expr("n00 + n01 + n10 + n11")
    for c in (0, 1):
        hit, support, called = F.col(f"n{c}{c}"), F.expr(f"n{c}0 + n{c}1"), F.expr(f"n0{c} + n1{c}")
        counts = counts.withColumns({f"p{c}": ratio(hit, called), f"r{c}": ratio(hit, support), f"s{c}": support})
        counts = counts.withColumn(f"f{c}", ratio(2 * F.col(f"p{c}") * F.col(f"r{c}"), F.col(f"p{c}") + F.col(f"r{c}")))

    def line(name: str, values: list[Column], support: Column) -> Column:
        parts = [v.alias(n) for n, v in zip(("precision", "recall", "f1"), values)]
        return F.struct(F.lit(name).alias("row"), *parts, support.cast("bigint").alias("support"))

    exact = F.expr("n00 + n11") / total
    lines = [line(str(c), [F.col(f"{m}{c}") for m in "prf"], F.col(f"s{c}")) for c in (0, 1)]
    lines.append(line("accuracy", [exact] * 3, total))
    lines.append(line("macro avg", [(F.col(f"{m}0") + F.col(f"{m}1")) / 2 for m in "prf"], total))
    lines.append(
        line("weighted avg", [F.expr(f"({m}0 * s0 + {m}1 * s1)") / total for m in "prf"], total)
    )
    return counts.select(*by, F.inline(F.array(*lines)))


def log_loss(df: DataFrame, by: list[str], score: str = "prob", label: str = "label") -> DataFrame:
    """Mean binary cross-entropy; each logarithm is bounded below by -100."""
    p, y = F.col(score), F.col(label)

    def bounded(x: Column) -> Column:
        return F.when(x <= 0, F.lit(-100.0)).otherwise(F.greatest(F.log(x), F.lit(-100.0)))

    return df.groupBy(*by).agg(F.avg(-(y * bounded(p) + (1 - y) * bounded(1 - p))).alias("log_loss"))
