from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from trialweave.llm import decontaminate as dc, words

VOCABULARY = [f"w{i}" for i in range(400)]


def levenshtein(a, b):
    """Least edits from a to any part of b, cell by cell."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance_is_that_of_the_table():
    draw = random.Random(2)
    for _ in range(200):
        a, b = (np.array(draw.choices(range(4), k=draw.randrange(1, 9)), np.uint64) for _ in range(2))
        assert dc.edit_distance(a, b)[0] == levenshtein(a.tolist(), b.tolist())


def edited(text, edits, draw):
    out = list(text)
    for _ in range(edits):
        at = draw.randrange(len(out))
        out[at : at + draw.choice([0, 1])] = draw.choice([[], draw.choices(VOCABULARY, k=1)])
    return out


@pytest.fixture(scope="module")
def case():
    draw = random.Random(7)
    items = [(i, draw.choices(VOCABULARY, k=draw.choice([5, 7, 9, 14, 30, 70]))) for i in range(40)]
    docs = []
    for d in range(160):
        item = items[d % 40][1]
        inside = edited(item, int(len(item) * draw.choice([0, 0.1, 0.2])), draw) if d < 120 else []
        docs.append((d, draw.choices(VOCABULARY, k=30) + inside + draw.choices(VOCABULARY, k=draw.choice([0, 30]))))
    return [(i, " ".join(t)) for i, t in items], [(d, " ".join(t)) for d, t in docs]


def test_passages_are_found_and_clean_documents_are_not(spark, case):
    items, docs = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.item_id): r for r in dc.find(frame, benchmark).collect()}
    rule = dc.Rule()
    want = {(d, i): n for d, t in docs for i, x in items if (n := levenshtein(x.split(), t.split())) <= rule.allowed(len(x.split()))}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    for (d, i), r in got.items():
        assert r.distance == want[d, i]
        part = dict(docs)[d].split()[r.start_word : r.start_word + r.n_words]
        assert levenshtein(dict(items)[i].split(), part) <= r.distance
    kept = {r.doc_id for r in dc.without_matches(frame, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_exact_passages_are_always_found(case):
    items, _ = case
    known = dc.Benchmark([i for i, _ in items], [t for _, t in items], dc.Rule())
    texts = [f"Before, {t.upper()}! after" for _, t in items] + [t for _, t in items]
    for low, high, values, firsts in words.hashed_words(pa.array(texts), words.MARKS):
        hits = {(low + h[0], known.ids[h[1]]) for h in known.hits(values, firsts) if h[4] == 0}
        assert hits >= {(k, items[k % 40][0]) for k in range(low, high)}


@pytest.mark.parametrize("n", [18, 26, 51, 97, 151, 235])
@pytest.mark.parametrize("mixed", [False, True])
def test_recall_at_the_edit_bound_does_not_fall_with_length(n, mixed):
    draw = random.Random(n)
    items = [[f"i{k}w{j}" for j in range(n)] for k in range(3000 // n + 10)]
    texts = []
    for item in items:
        out = list(item)
        for at in sorted(draw.sample(range(n), n // 5), reverse=True):
            kind = draw.randrange(3) if mixed else 0
            out[at : at + (kind < 2)] = [] if kind == 1 else [f"new{draw.random()}"]
        texts.append(" ".join(["before", "it", *out, *(f"then{draw.random()}" for _ in range(n))]).replace("0.", ""))
    known = dc.Benchmark(list(range(len(items))), [" ".join(x) for x in items], dc.Rule())
    found = set()
    for low, _, values, firsts in words.hashed_words(pa.array(texts), words.MARKS):
        found |= {low + h[0] for h in known.hits(values, firsts) if known.ids[h[1]] == low + h[0]}
    assert len(found) >= 0.95 * len(items)


def test_blocks_give_the_same(spark, case, monkeypatch):
    items, docs = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs[:60], "doc_id long, text string")
    one = sorted(map(tuple, dc.find(frame, benchmark).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1500)
    many = sorted(map(tuple, dc.find(frame, benchmark).collect()))
    assert {r[:2] for r in one} == {r[:2] for r in many}


def test_edges(spark, edges, nothing):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven", "x"), (2, None, "x"), (None, "word", "x"), (4, "", "x"), (5, "a row without AN id has five words", "x")], "item_id long, text string, key string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in dc.find(edges, benchmark).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 1, 0), (2, 1, 0), (None, 5, 0)], key=str)
    kept = dc.without_matches(edges, benchmark)
    assert kept.columns == edges.columns and kept.count() == edges.count() - 4
    assert dc.find(nothing, benchmark).count() == 0 and dc.without_matches(nothing, benchmark).count() == 0
    assert dc.find(edges, benchmark.where("false")).count() == 0 and dc.without_matches(edges, benchmark.where("false")).count() == edges.count()


def test_a_recall_out_of_reach_is_an_error():
    """Every class of the rule reaches the target; a share of edits that cannot is said to."""
    rule, n = dc.Rule(), 5
    while n < 3000:
        assert dc.repetitions(*rule.searched(n)) < dc.MOST_REPETITIONS
        n = rule.next_window(n)
    with pytest.raises(ValueError, match="repetitions find"):
        dc.repetitions(20, 12)
