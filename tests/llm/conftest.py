from __future__ import annotations

import pytest

#: Nulls in every column, empty, blank, one-word and repeated rows, ties, and a long text without a space.
EDGES = [
    (1, "One two three four five six seven.\nA second line of the first text here.", "en", "a"),
    (2, "One two three four five six seven.\nA second line of the first text here.", "en", "a"),
    (2, "One two three four five six seven.\nA second line of the first text here.", "en", "a"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t\n ", "fr", None),
    (6, "word", None, "b"),
    (None, "A row without an id has five words and more.", "de", "b"),
    (None, None, None, None),
    (7, "x" * 3000 + " Größe İ 😀 日本語", "de", "c"),
    (8, "Released under the MIT License.\r\nCopyright (c) 2020 Somebody\rlast line", "en", "c"),
]


@pytest.fixture(scope="session")
def edges(spark):
    """The edge rows with extra columns that carry names which operators use themselves."""
    rows = [(*r, 1, "x", [1], 2.5, "k") for r in EDGES]
    names = "doc_id long, text string, lang string, source string, size int, hash string, lines array<int>, host double, key string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.where("doc_id = -1")
