from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialweave.llm import spelling
from trialweave.llm.queries import QUERIES


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, least_length=7, least_count=2, factor=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: best[w] if best[w] is not None and n[best[w]] >= factor * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(frame):
    rows = frame.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("cells", [spelling.CELLS, 40])
def test_pairs_against_all_pairs(spark, cells):
    """Words of any length, repeated letters, one pair of huge groups, and groups split down to one position."""
    draw = random.Random(3)
    vocabulary = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 8))) for _ in range(500)} | {"a" * i for i in range(1, 30)}
    vocabulary |= {"kontinuum" + x + y for x in "abcdefgh" for y in ["", *"abcd"]} | {x + "kontinuum" for x in "abcdefgh"}
    vocabulary = sorted(vocabulary)
    frame = spark.createDataFrame([(w, i) for i, w in enumerate(vocabulary)], "word string, n long").repartition(4)
    got = sorted(tuple(r) for r in spelling.near_words(frame, cells).collect())
    assert got == sorted((a, b, i) for a in vocabulary for i, b in enumerate(vocabulary) if one_edit(a, b))


def test_crowded_groups_are_split(spark):
    vocabulary = spark.createDataFrame([(f"{'x' * 10}{i:03d}{j:03d}".translate(str.maketrans("0123456789", "abcdefghij")), 2) for i in range(10) for j in range(40)], "word string, n long")
    sizes = spelling._bounded_groups(vocabulary, 500).groupBy(*spelling._KEY).agg(F.sum(F.length("inner")).alias("cells"))
    assert sizes.where("hi - lo > 1").agg(F.max("cells")).first()[0] <= 500


def test_rows_against_the_plain_version(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdeßü") for _ in range(draw.randint(6, 11))) for _ in range(40)]
    docs = []
    for i in range(300):
        picked = [draw.choice(base[: draw.choice([3, 40])]) for _ in range(30)]
        picked = [w.upper() if draw.random() < 0.1 else w[:4] + draw.choice("abc") + w[5:] if draw.random() < 0.1 else w for w in picked]
        docs.append((i, draw.choice([" ", "-", "1", "Ā"]).join(picked)))
    docs += [(None, "abcdefgh abcdefgh"), (1000, None), (1001, ""), (1001, ""), (1002, "y" * 5000 + " " + "y" * 4999 + " " + "y" * 5000 + " " + "y" * 4999)]
    frame = spark.createDataFrame([(*d, 1, "a", 2, 3) for d in docs], "doc_id long, text string, word int, form string, n int, id int")
    got, want = found(spelling.group_variants(frame)), plain(docs)
    assert got == want
    assert any(f is not None and r != f for f, r, *_ in want.values()) and any(n > 3 for *_, n, _ in want.values())


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert found(spelling.group_variants(edges)) == plain(rows)
    assert spelling.group_variants(nothing).count() == 0
    assert spelling.near_words(spark.createDataFrame([], "word string, n long")).count() == 0


def test_the_query_against_the_plain_version(spark, sf):
    """Counts and forms of every word; near words, which the plain version finds among all pairs, of forty."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = found(QUERIES["op12_spelling_variants"](spark, sf))
    for w in random.Random(1).sample(sorted(got), 40):
        near = [x for x in got if one_edit(w, x)]
        best = min(near, key=lambda x: (-got[x][2], x), default=None)
        form = best if best is not None and got[best][2] >= 10 * got[w][2] else None
        assert got[w][:1] + got[w][3:] == (form, len(near), got[form][2] if form else None)
        assert got[w][1] == (got[form][1] if form else w)
    assert len(rows) == 200
