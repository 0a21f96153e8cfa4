from __future__ import annotations

import random
import re

import pytest

from trialweave.llm import ngram_join as nj


def brute(rows, n, share):
    """(set size, smallest key of the component) by comparing every pair."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common * share[1] >= share[0] * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    keys = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            keys[find(i)] = min(k, keys.get(find(i), k))
    return sorted(((rows[i][0], len(sets[i]), keys.get(find(i)) if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


def got(spark, rows, n, share):
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, size int, class string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nj.join_documents(frame, n=n, share=share).collect()), key=str)


def near_copies(seed, n_sources=12, copies=8):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n_sources):
        text = draw.choices(vocabulary, k=draw.choice([4, 12, 25, 60, 200]))
        for _ in range(copies):
            other = list(text)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                at = draw.randrange(len(other))
                other[at : at + draw.choice([0, 1])] = draw.choices(vocabulary, k=1)
            text = other if draw.random() < 0.5 else text
            rows.append((len(rows), " ".join(other)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, n, share", [(1, 3, (9, 10)), (2, 5, (4, 5)), (3, 3, (1, 2))])
def test_components_are_those_of_all_pairs(spark, seed, n, share):
    rows = near_copies(seed)
    assert got(spark, rows, n, share) == brute(rows, n, share)


def test_edges_and_repeated_rows(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    out = nj.join_documents(edges, n=3, share=(9, 10))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str) == brute(rows, 3, (9, 10))
    assert nj.join_documents(nothing).count() == 0


def test_a_hot_group_and_null_keys(spark):
    base = [f"v{i}" for i in range(60)]
    rows = [(i if i % 3 else None, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(1, 120) for k in [i % 60]]
    assert got(spark, rows, 3, (4, 5)) == brute(rows, 3, (4, 5))


def test_parts_are_enough_for_every_linked_pair():
    for share in ((9, 10), (4, 5), (1, 2)):
        bands = nj.Bands(share)
        for small in range(1, 120):
            for large in range(small, small * share[1] // share[0] + 1):
                least = -(-share[0] * (small + large) // (share[0] + share[1]))  # overlap of a linked pair
                if least <= small:
                    assert bands.of(large) - bands.of(small) in (0, 1)
                    assert small + large - 2 * least <= bands.differing(bands.of(large))
