from __future__ import annotations

import importlib
import subprocess
import sys
from pathlib import Path

import pytest
from check import compare, connect

import __spark_entry__
import corpus_pipeline
from trialweave.llm import queries
from trialweave.session import cut_lineage


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    assert compare(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]).startswith("ok")


def test_stages_over_the_edges(spark, edges, sf):
    docs = edges.select("doc_id", "text", "lang", "source", "size").withColumnRenamed("size", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = cut_lineage(stage(spark, docs, sf))
        if k < 4:
            assert out.columns == docs.columns
            empty = stage(spark, docs.where("false"), sf)
            assert empty.count() == 0
            docs = out
    assert out.columns == ["doc_id", "ids", "n_pieces"]


def test_copies_and_benchmark_passages_go_and_clean_documents_stay(spark, sf):
    words = [f"plain{i}" for i in range(200)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    text = " ".join(words)
    rows = [
        (1, f"{text}\nits first own line is here"), (2, f"{text}\nits first own line is here"), (3, " ".join([*words[:100], "changed", *words[101:]])),
        (4, f"before that {item} and after"), (5, " ".join(reversed(words))),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = cut_lineage(stage(spark, docs, sf))
    assert {r.doc_id for r in docs.collect()} == {1, 5}


def test_the_whole_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = out.collect()
    assert 0 < len(rows) < docs.count() and all(r.n_pieces == len(r.ids) for r in rows)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows}
    bad = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_the_rest_works_without_the_folders():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'trialweave.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\n"
    )
    root = Path(importlib.import_module("corpus_pipeline").__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
