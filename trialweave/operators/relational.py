"""Column selection, joins and aggregations that the cohort flow needs beyond plain DataFrame calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, StructType

from trialweave.session import cut_lineage

# Columns of a modelling table that are never features. Fixed values.
NON_FEATURES = ["imageName", "Group", "set", "ORR", "y"]


def to_front(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names, *[c for c in df.columns if c not in names])


def drop_range(df: DataFrame, first: int, last: str) -> DataFrame:
    """Drop the columns from position first up to and including the named one."""
    end = df.columns.index(last)
    return df.select(*df.columns[:first], *df.columns[end + 1 :])


def feature_columns(schema: StructType, exclude: list[str]) -> list[str]:
    return [n for n in schema.fieldNames() if n not in exclude]


def numeric_columns(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, NumericType)]


def join_null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that pairs null keys with null keys."""
    other = right.withColumnRenamed(key, f"_right_{key}")
    return left.join(other, left[key].eqNullSafe(other[f"_right_{key}"]), "inner").drop(f"_right_{key}")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """Attach the value of a key table that holds each key once; rows without an entry get the default.

    The key table is written first: its size is then known when the join is planned, so a small one is broadcast and the rows stay
    where they are, and a large one is joined by a shuffle.
    """
    return df.join(cut_lineage(table.select(*keys, value)), keys, "left").withColumn(value, F.coalesce(value, default))


def unsent(table: DataFrame) -> DataFrame:
    """The table, joined by shuffle and sort whatever the planner takes its size for.

    The planner weighs a table by its compressed files. Keys and small numbers take a few bytes a row there and some hundred as a broadcast table, all of which
    the driver makes and keeps, so a table with a row for each key of the data is not to be broadcast.
    """
    return table.hint("merge")


#: Rows of a table that may be broadcast.
SENT_ROWS = 200_000


def sent_if_few(written: DataFrame) -> DataFrame:
    """A written table, which is not broadcast where it has more than SENT_ROWS rows."""
    return unsent(written) if written.count() > SENT_ROWS else written


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str], salts: int = 16) -> DataFrame:
    """Inner join of many rows per key with one row per key, where a key may hold most of the rows.

    The rows of a key are split by a hash of other columns, and the one row of the table is sent to each
    part; the result is no longer laid out by key, so later steps spread a hot key as well. The planner weighs the copies as one, so they are never broadcast.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(unsent(copies), [*keys, "_salt"]).drop("_salt")


def group_count(df: DataFrame, keys: list[str], name: str = "count") -> DataFrame:
    """Rows per key combination; a null in any key drops the row."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(name))


def aligned_counts(left: DataFrame, right: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Two grouped counts on the union of their keys, a missing side counts 0."""
    counts = group_count(left, keys, names[0]).join(group_count(right, keys, names[1]), keys, "full_outer")
    return counts.fillna(0, subset=list(names))


def null_audit(df: DataFrame) -> DataFrame:
    """Columns that contain nulls and how many, from one aggregation."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "nulls")
    return long.filter("nulls > 0")


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def column_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (feature, mean, std) with the population standard deviation, from one aggregation."""
    wide = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "m").select("feature", "m.mean", "m.std")


def top_k(df: DataFrame, value: str, name: str, k: int = 20) -> DataFrame:
    return df.orderBy(F.desc(value), F.asc(name)).limit(k)


def above_nth_largest(df: DataFrame, value: str, n: int) -> DataFrame:
    """Rows strictly above the n-th largest value: n-1 rows without ties, never n."""
    nth = df.select(value).orderBy(F.desc(value)).limit(n).agg(F.min(value)).first()[0]
    return df.filter(F.col(value) > F.lit(nth))


def two_lowest(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The two first rows of each group. The rank limit is applied before the shuffle as well as after,
    so a map task sends at most two rows per group."""
    first = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("slot", F.row_number().over(first)).filter("slot <= 2")


def slice_order(df: DataFrame) -> DataFrame:
    """Every slice with its 0-based slice_number in its series, by z, slice location and path, nulls first: one shuffle, since a scanner bounds the slices of a series."""
    order = Window.partitionBy("series").orderBy("z", "slice_location", "path")
    return df.withColumn("slice_number", (F.row_number().over(order) - 1).cast("long"))


def slice_thickness(df: DataFrame) -> DataFrame:
    """Distance of the two lowest slices of a series, on z or else on the slice location, on every slice."""
    lowest = two_lowest(
        df.select("series", "z", "slice_location", "path"),
        "series",
        [F.asc_nulls_last("z"), F.asc_nulls_last("slice_location"), F.asc("path")],
    )

    def gap(column: str) -> Column:
        pair = [F.max(F.when(F.col("slot") == s, F.col(column))) for s in (1, 2)]
        return F.abs(pair[0] - pair[1])

    gaps = lowest.groupBy("series").agg(F.coalesce(gap("z"), gap("slice_location")).alias("thickness"))
    return df.join(gaps, "series", "left")
