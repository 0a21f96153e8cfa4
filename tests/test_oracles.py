"""Every query with an oracle against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest
from check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

# These run for half a minute or more: SLOW=1 includes them here, and tools/check.py covers them.
LONG = {
    "extract_features", "extract_features_filtered", "filter_wavelet", "gbt_classify", "gbt_regress", "gbt_classify_sampled",
    "gbt_classify_target_encoded", "weighted_fit", "class_weighted_fit", "svm_classify", "select_by_shadow", "train_history", "extraction_job",
}
NAMES = [n for n in queries() if n in oracle_sql() and not n.startswith("op") and (os.environ.get("SLOW") or n not in LONG)]


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, duck, name):
    outcome = compare(queries()[name](spark, sf), duck, oracle_sql()[name])
    assert outcome.startswith("ok") and "TYPES" not in outcome, outcome


def test_entry_has_four_cells(spark):
    rows = entry(spark).collect()
    assert {(r.label, r.prediction) for r in rows} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert rows[0].auc >= 0.8
