from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialweave.llm import shards


def test_every_row_has_a_slot_without_gaps(spark, edges):
    out = shards.shard_documents(edges, [1.0] * 4, [1.0] * 5).collect()
    assert len(out) == edges.count()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in edges.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts


def test_a_new_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20000).withColumn("text", F.lit("t")).withColumnRenamed("id", "doc_id")
    out = shards.shard_documents(ids, [1.0] * 16, [1.0] * 17).collect()
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    moved = sum(r.grown_shard == 16 for r in out)
    assert 0.8 * 20000 / 17 < moved < 1.2 * 20000 / 17
    again = {r.doc_id: r.shard for r in shards.shard_documents(ids.where("doc_id % 3 = 0"), [1.0] * 16).collect()}
    assert all(again.get(r.doc_id, r.shard) == r.shard for r in out)


def test_weights_share_out_the_keys_and_change_little(spark):
    ids = spark.range(20000).select(F.col("id"), shards.rendezvous(F.col("id"), [1.0, 3.0]).alias("a"), shards.rendezvous(F.col("id"), [1.0, 4.0]).alias("b"))
    rows = ids.collect()
    assert abs(sum(r.a for r in rows) / 20000 - 0.75) < 0.02 and abs(sum(r.b for r in rows) / 20000 - 0.8) < 0.02
    assert not any(r.a == 1 and r.b == 0 for r in rows)


def test_one_record_repeated_and_no_rows(spark, nothing):
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    assert sorted(r.slot for r in shards.shard_documents(same, [1.0]).collect()) == list(range(500))
    assert shards.shard_documents(nothing, [1.0] * 16).count() == 0
    with pytest.raises(ValueError):
        shards.rendezvous(F.lit(1), [0.0])


def test_written_shards_are_those_of_the_hash(spark, edges):
    from trialweave.session import scratch_path

    path = scratch_path(spark, "shards")
    shards.write_shards(edges, path, [1.0, 1.0])
    back = spark.read.parquet(path)
    assert back.count() == edges.count()
    assert back.where(F.col("shard") != shards.rendezvous(F.col("doc_id"), [1.0, 1.0])).count() == 0
