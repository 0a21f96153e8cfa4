"""Rendezvous hashing of record keys over weighted shards, and a gapless slot for each record of a shard."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Hex digits of md5 that make the uniform number (52 bits, exact in a double).
_DIGITS = 13
_BUCKET_DIGITS = 3


def _hex(text: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float], salt: str = "") -> Column:
    """Shard 0 .. len(weights) - 1 of each key: the shard with the largest -weight / ln(u), u from md5(key, shard).

    Each shard's value for a key depends on that shard alone, so a new shard takes records only into itself, a removed
    one gives up only its own, and a changed weight moves records only to or from that shard. A share of the keys
    proportional to the weight falls to each shard. A null key is the key "" and has a shard like any other. Ties (2^-52)
    go to the larger shard number.
    """
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("each shard needs a positive, finite weight")
    text = F.coalesce(key.cast("string"), F.lit(""))
    values = []
    for shard, weight in enumerate(weights):
        draw = (_hex(F.concat(text, F.lit(f":{salt}{shard}")), 1, _DIGITS) + 0.5) / F.lit(float(16**_DIGITS))
        values.append(F.struct((F.lit(-float(weight)) / F.log(draw)).alias("value"), F.lit(shard).alias("shard")))
    return (values[0] if len(values) == 1 else F.greatest(*values))["shard"]


def with_slots(records: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add `slot`: 0, 1, 2, ... without gaps within each shard, in the order of (bucket, order columns).

    A bucket is a hash prefix of the order columns: each of shards x 4096 buckets is numbered on its own and starts
    where the earlier buckets of its shard end, so no task holds a whole shard. Equal records are counted before the
    shuffle and expanded at the end, so a record repeated in a third of all rows is one row for each task. Only the shard and order columns
    are kept: join back by key, or pass every column that is needed in `order`.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    counted = (
        records.select(shard, *order, F.substring(F.md5(text), 1, _BUCKET_DIGITS).alias("_bucket"))
        .groupBy(shard, "_bucket", *order)
        .agg(F.count("*").alias("_copies"))
    )
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy(shard, "_bucket")
        .agg(F.sum("_copies").alias("_rows"))
        .select(F.col(shard).alias("_shard"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    numbered = counted.withColumn("_inside", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    return (
        numbered.join(starts, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_of")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
        .select(shard, *order, (F.col("_start") + F.col("_inside") + F.col("_copy")).alias("slot"))
    )


def shard_documents(
    docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Digest of each document with its shard, its slot in the shard, and its shard once `grown` weights are in use.

    Columns: key, size (UTF-8 bytes + 1; a null text has 1), text_crc32 (unsigned; 0 for a null text), shard, slot,
    grown_shard (null without `grown`). The key alone decides the shard: repeated keys share it, a null key counts as
    "". An empty table gives no rows; columns beside key and text are not read, whatever their names.
    """
    digest = docs.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("_crc"),
        rendezvous(F.col(key), weights).alias("_to"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None)).cast("int").alias("_grown"),
    )
    slots = with_slots(digest, "_to", ["_key", "_size", "_crc", "_grown"])
    return slots.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_to").alias("shard"), "slot", F.col("_grown").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id") -> None:
    """The documents as one Parquet folder for each shard, in one pass without a shuffle."""
    docs.withColumn("shard", rendezvous(F.col(key), weights)).write.partitionBy("shard").parquet(path)
