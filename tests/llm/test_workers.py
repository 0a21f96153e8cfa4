"""Python steps that give memory back between tasks."""

from __future__ import annotations

import pyarrow as pa
import pytest

import corpus_pipeline
from trialweave.llm import decontaminate, line_dedup, ngram_join, quality, workers
from trialweave.session import cut_lineage


def test_memory_is_given_back_before_and_after_a_step(monkeypatch):
    told = []
    monkeypatch.setattr(workers, "give_back", lambda: told.append("back"))

    def step(parts):
        for p in parts:
            told.append(p.num_rows)
            yield p

    rows = [pa.record_batch({"x": [1, 2]}), pa.record_batch({"x": [3]})]
    assert list(workers.lean(step)(iter(rows))) == rows and told == ["back", 2, 1, "back"]


def test_every_step_of_the_stages_before_the_last_is_lean(spark, sf, monkeypatch):
    seen = set()
    for module in (quality, line_dedup, ngram_join, decontaminate):
        monkeypatch.setattr(module, "lean", lambda step, name=module.__name__.rpartition(".")[2]: seen.add((name, step.__name__)) or step)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = cut_lineage(stage(spark, docs, sf))
    assert {("quality", "batches"), ("line_dedup", "runs"), ("line_dedup", "align"), ("ngram_join", "batches"), ("ngram_join", "exact"), ("ngram_join", "linked"), ("decontaminate", "batches")} <= seen


@pytest.mark.parametrize("rows", [1, 2, 100])
def test_sketches_do_not_depend_on_how_many_are_made_at_once(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three four five six number{i % 4}") for i in range(9)], "doc_id long, text string").coalesce(1)
    want = {r.key: r.size for r in ngram_join.sketches(docs, "doc_id", "text", 5, ngram_join.Bands((4, 5))).collect()}
    monkeypatch.setattr(ngram_join, "ROWS", rows)
    got = ngram_join.sketches(docs, "doc_id", "text", 5, ngram_join.Bands((4, 5))).collect()
    assert {r.key: r.size for r in got} == want and sum(r.tiles is not None for r in got) == 4
