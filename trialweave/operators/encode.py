"""Encoders that are fitted on one frame and applied to others. Fitted state is a table or one row."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from trialweave.operators.ranking import positions
from trialweave.session import cut_lineage


#: Values of a dictionary that every task may have, and their longest length in characters; together they bound what is broadcast.
HEAVY, HEAVY_LENGTH = 1_000, 256


class CategoryCodes:
    """Sorted distinct values -> 0..k-1, null and unseen -> -1. The vocabulary stays a distributed table, written when it is fitted.

    The most frequent values, at most `HEAVY` of at most `HEAVY_LENGTH` characters, are looked up in a broadcast table, so a skewed column is not
    shuffled on its hot values. Other values meet the rest of the vocabulary by a hash join, if there is a rest; rows that
    already have their code, and nulls, are spread over it by a hash of the row.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def fit(self, df: DataFrame) -> CategoryCodes:
        self.tables, self.heavy, self.rest = {}, {}, {}
        for c in self.columns:
            counted = cut_lineage(df.select(c).dropna().groupBy(c).agg(F.count(F.lit(1)).alias("_n")))
            codes = self.tables[c] = cut_lineage(positions(counted, [], [c], "_code"))
            short = codes.where(F.length(F.col(c).cast("string")) <= HEAVY_LENGTH)
            self.heavy[c] = cut_lineage(short.orderBy(F.desc("_n"), "_code").limit(HEAVY).drop("_n"))
            others = codes.join(F.broadcast(self.heavy[c].select("_code")), "_code", "left_anti").select(c, "_code")
            self.rest[c] = None if codes.count() == self.heavy[c].count() else cut_lineage(others)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        hashed = [n for n, t in df.dtypes if not t.startswith(("map", "variant"))]
        for c in self.columns:
            coded = df.join(F.broadcast(self.heavy[c].withColumnRenamed("_code", "_heavy")), c, "left")
            found = F.col("_heavy")
            if self.rest[c] is not None:
                done = F.col("_heavy").isNotNull() | F.col(c).isNull()
                spread = coded.withColumn("_open", F.when(~done, F.col(c))).withColumn("_salt", F.when(done, F.xxhash64(*hashed)).otherwise(0))
                rest = self.rest[c].select(F.col(c).alias("_open"), "_code", F.lit(0).cast("bigint").alias("_salt"))
                coded, found = spread.join(rest, ["_open", "_salt"], "left"), F.coalesce("_heavy", "_code")
            df = coded.withColumn(c, F.coalesce(found, F.lit(-1)).cast("int")).select(order)
        return df


class MomentScaler:
    """(x - mean) / population standard deviation; a constant column is divided by 1."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def fit(self, df: DataFrame) -> MomentScaler:
        row = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in self.columns]).first()
        self.moments = {c: tuple(row[c]) for c in self.columns}
        return self

    def scaled(self, column: str) -> Column:
        mean, std = self.moments[column]
        return (F.col(column) - F.lit(mean)) / F.lit(std or 1.0)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.scaled(c) for c in self.columns})


def impute_mean(df: DataFrame, columns: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Null -> mean of the column in the frame the imputer is fitted on."""
    imputer = Imputer(strategy="mean", inputCols=columns, outputCols=columns)
    return imputer.fit(df if fitted_on is None else fitted_on).transform(df)


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale", TypeConverters.toListString)
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population deviations", TypeConverters.toListFloat)


class PopulationScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """MomentScaler as a pipeline stage (the built-in StandardScaler divides by the sample deviation)."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        columns = self.getOrDefault("inputCols")
        fitted = MomentScaler(columns).fit(df).moments
        return PopulationScalerModel()._set(
            inputCols=columns, means=[fitted[c][0] for c in columns], stds=[fitted[c][1] for c in columns]
        )


class PopulationScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        scaler = MomentScaler(self.getOrDefault("inputCols"))
        pairs = zip(self.getOrDefault("means"), self.getOrDefault("stds"))
        scaler.moments = dict(zip(scaler.columns, pairs))
        return scaler.transform(df)


def mean_filled(columns: list[str]) -> list:
    """Stages that add `<column>_value`: the column as a double, nulls replaced by the mean of the rows they are fitted on."""
    doubles = ", ".join(f"cast(`{c}` as double) as `{c}_value`" for c in columns)
    values = [f"{c}_value" for c in columns]
    return [SQLTransformer(statement=f"SELECT *, {doubles} FROM __THIS__"), Imputer(strategy="mean", inputCols=values, outputCols=values)]


def fill_text(columns: list[str], value: str = "Missing") -> SQLTransformer:
    """Stage that gives null its own category; other columns pass through."""
    filled = ", ".join(f"coalesce(cast(`{c}` as string), '{value}') as `{c}_text`" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")


def one_hot_stages(columns: list[str]) -> list:
    """One 0/1 entry per category seen in fit, in sorted order; an unseen value is all zeros.

    With handleInvalid=keep the unseen bucket is the last index, and dropLast removes just that one.
    """
    return [
        StringIndexer(
            inputCols=columns,
            outputCols=[f"{c}_index" for c in columns],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_onehot" for c in columns], dropLast=True
        ),
    ]


def preprocessor(numeric: list[str], categorical: list[str], scale: bool = False, output: str = "features") -> Pipeline:
    """Numeric branch (mean imputation, optional scaling) and categorical branch (fill, one-hot) side by side.

    Fit on training rows only; all statistics and categories come from them.
    """
    values = [f"{c}_value" for c in numeric]
    stages: list = mean_filled(numeric)
    if scale:
        stages.append(PopulationScaler(inputCols=values))
    if categorical:
        stages += [fill_text(categorical), *one_hot_stages([f"{c}_text" for c in categorical])]
    stages.append(
        VectorAssembler(inputCols=values + [f"{c}_text_onehot" for c in categorical], outputCol=output)
    )
    return Pipeline(stages=stages)


def boxcox_log_likelihoods(df: DataFrame, column: str, lambdas: list[float]) -> DataFrame:
    """Log-likelihood of the Box-Cox transform per lambda, from one aggregation over the table."""
    x = F.col(column).cast(DoubleType())

    def likelihood(lam: float) -> Column:
        y = F.log(x) if lam == 0 else F.pow(x, F.lit(lam)) / F.lit(lam)
        return F.lit(lam - 1.0) * F.sum(F.log(x)) - F.count(x) / 2 * F.log(F.var_pop(y))

    wide = df.agg(
        F.array(
            *[F.struct(F.lit(lam).alias("lambda"), likelihood(lam).alias("log_likelihood")) for lam in lambdas]
        ).alias("points")
    )
    return wide.select(F.inline("points"))


def boxcox_fit(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, points: int = 21) -> float:
    """Lambda of the largest likelihood: a grid, narrowed around its best point until 1e-6 wide."""
    while high - low > 1e-6:
        step = (high - low) / (points - 1)
        grid = [round(low + i * step, 12) for i in range(points)]
        best = boxcox_log_likelihoods(df, column, grid).orderBy(F.desc("log_likelihood")).first()["lambda"]
        low, high = best - step, best + step
    return best
