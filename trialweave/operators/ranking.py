"""Exact order-dependent work that no single task has to sort whole.

A group is cut into buckets that follow its order. Each bucket is numbered or summed on its own, and
the totals of the earlier buckets are added as an offset. Any choice of cuts gives the same result; the
cuts only decide how evenly the work spreads, so a group that holds most of the rows is many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegralType

from trialweave.operators.relational import unsent

HASH_DIGITS = 4


#: Rows that a bucket should hold; a table of more rows is cut into more buckets.
ROWS_PER_BUCKET = 200_000
#: Accuracy of the quantile sketch (ranks are right to about 1/10,000 of the rows), and sampled keys where there is no sketch for the type.
SKETCH_K, SAMPLE_KEYS = 16_384, 32_768
#: Cuts that are written out as conditions; more are searched in an array.
WRITTEN_CUTS = 256


def _buckets(df: DataFrame, rows: int) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_PER_BUCKET))


def order_cuts(df: DataFrame, order: list[str], buckets: int | None = None) -> list[tuple]:
    """Cut points over the order columns, from one scan that also tells the number of rows, which their number follows.

    One numeric column is sketched (KLL, merged by the aggregate); its nulls and NaNs lie outside the cuts, first and last. Other orders take the keys of
    the `SAMPLE_KEYS` rows of the smallest random numbers (the last of which tells how many rows there are), nulls first as in the comparison of rows.
    """
    kind = df.schema[order[0]].dataType
    if len(order) == 1 and isinstance(kind, (IntegralType, FloatType, DoubleType)):
        return _sketched_cuts(df, order[0], kind, buckets)
    drawn = df.select(*order, F.rand(17).alias("_drawn")).orderBy("_drawn").limit(SAMPLE_KEYS).collect()
    if not drawn:
        return []
    rows = len(drawn) if len(drawn) < SAMPLE_KEYS else int(len(drawn) / drawn[-1]["_drawn"])
    keys = sorted((tuple(row)[:-1] for row in drawn), key=_nulls_first)
    buckets = buckets or _buckets(df, rows)
    chosen = {keys[len(keys) * i // buckets] for i in range(1, buckets)}
    return sorted(chosen, key=_nulls_first)


def _sketched_cuts(df: DataFrame, column: str, kind: DataType, buckets: int | None) -> list[tuple]:
    whole = isinstance(kind, IntegralType)
    value = F.col(column).cast("bigint" if whole else "double")
    make, ask, size = (
        (F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint, F.kll_sketch_get_n_bigint)
        if whole
        else (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double, F.kll_sketch_get_n_double)
    )
    if not whole:
        value = F.when(~F.isnan(value), value)
    sketch = df.agg(make(value, F.lit(SKETCH_K)).alias("sketch"), F.count(F.lit(1)).alias("rows"))
    found = sketch.where(size("sketch") > 0).collect()
    if not found:
        return []
    n = buckets or _buckets(df, found[0]["rows"])
    ranks = F.array(*[F.lit(i / n) for i in range(1, n)])
    kept = df.sparkSession.createDataFrame([(bytes(found[0]["sketch"]),)], "sketch binary")
    cuts = set(kept.select(ask("sketch", ranks).alias("cuts")).first()["cuts"]) if n > 1 else set()
    return [(v,) for v in sorted(cuts)]


def _nulls_first(key: tuple) -> tuple:
    return tuple((v is not None, v) for v in key)


def _bucket(df: DataFrame, order: list[str], cuts: list[tuple]) -> Column:
    """Number of cuts at or below the row, by binary search: nested conditions for few cuts, halving steps over an array for many."""
    key = F.struct(*order)
    types = [df.schema[c].dataType for c in order]
    points = [F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(cut, types, order)]) for cut in cuts]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < points[middle], search(low, middle)).otherwise(search(middle + 1, high))

    if len(cuts) <= WRITTEN_CUTS:
        return search(0, len(cuts))
    listed = F.array(*points)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= key, at + step).otherwise(at))


def hash_key(column: str, seed: int) -> Column:
    """Repeatable shuffle order: md5 of seed and id, the same on every engine and every layout. A null id hashes like no text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("\x00"))))


def _with_offsets(df: DataFrame, group: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add to every row, as _before_<name>, the sums over the earlier buckets of its group."""
    totals = df.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = (
        Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(g).alias(f"_group_{g}") for g in group],
        F.col("_bucket").alias("_bucket_of"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    if group:
        offsets = unsent(offsets)
    condition = df["_bucket"].eqNullSafe(offsets["_bucket_of"])
    for g in group:
        condition = condition & df[g].eqNullSafe(offsets[f"_group_{g}"])
    return df.join(offsets, condition).drop("_bucket_of", *[f"_group_{g}" for g in group])


def running_sums(
    df: DataFrame, group: list[str], order: str, sums: dict[str, str], cuts: list[tuple] | None = None
) -> DataFrame:
    """Running totals of columns inside each group in ascending order of a numeric column.

    The rows should be grouped by (group, order) before, so that each order value occurs once.
    """
    cuts = order_cuts(df, [order]) if cuts is None else cuts
    spread = df.withColumn("_bucket", _bucket(df, [order], cuts))
    joined = _with_offsets(spread, group, {n: F.col(c) for n, c in sums.items()})
    within = (
        Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for name, column in sums.items():
        joined = joined.withColumn(name, F.sum(column).over(within) + F.col(f"_before_{name}"))
    return joined.drop("_bucket", *[f"_before_{n}" for n in sums])


def positions(
    df: DataFrame, group: list[str], order: list[str], name: str, cuts: list[tuple] | None = None
) -> DataFrame:
    """0-based position of each row inside its group, ascending by the order columns."""
    cuts = order_cuts(df, order) if cuts is None else cuts
    return _number(df.withColumn("_bucket", _bucket(df, order, cuts)), group, order, name)


def hash_positions(
    df: DataFrame, group: list[str], key: str, seed: int, name: str, digits: int = HASH_DIGITS
) -> DataFrame:
    """0-based position inside the group in the order of hash_key; the first hex digits are the buckets."""
    hashed = df.withColumn("_hash", hash_key(key, seed))
    spread = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    return _number(spread, group, ["_hash", key], name).drop("_hash")


def _number(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    joined = _with_offsets(df, group, {"rows": F.lit(1)})
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    position = F.row_number().over(within) - 1 + F.col("_before_rows")
    return joined.withColumn(name, position.cast("bigint")).drop("_bucket", "_before_rows")


def smallest_hashes(df: DataFrame, key: str, seed: int, n: int, digits: int = HASH_DIGITS) -> str | None:
    """The hash of the n-th row in hash order, found digit by digit from counts.

    Each pass counts the rows per next few hex digits, so at most 16**digits rows reach the driver and
    the table itself is never sorted. Rows at or below the returned hash are the first n, for unique keys; rows
    that share a key (null counts as one) lie on the same side of the cut.
    """
    if n <= 0:
        return None
    hashed = df.select(hash_key(key, seed).alias("h"))
    prefix, last = "", 0
    while len(prefix) < 32:
        counts = (
            hashed.filter(F.col("h").startswith(prefix))
            .groupBy(F.substring("h", 1, len(prefix) + digits).alias("p"))
            .agg(F.count("*").alias("n"))
            .orderBy("p")
            .collect()
        )
        for row in counts:
            prefix, last = row.p, row.n
            if n <= last:
                break
            n -= last
        if n == last:
            break
    return prefix + "g" * (32 - len(prefix))
