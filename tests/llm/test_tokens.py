"""Token counts and the lattice against the library, with the same pieces and scores as a unigram model."""

from __future__ import annotations

import pytest

from trialweave.llm import lattice, queries, token_counts
from trialweave.llm.pieces import load_pieces
from trialweave.llm.queries import PIECES

TEXTS = ["", None, "a  b   c\n\n x ", "日本語テキスト😀 zz", "   ", "\r\n;\r x", "ab" * 300 + "😀" * 40, "The internationalisation of the the the.\nErreur été", "\x00  tab\tend"]


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(PIECES)


@pytest.fixture(scope="module")
def unigram(pieces):
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.piece in pieces.pieces:
            p.score = pieces.pieces[p.piece][1]
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def docs(spark, sf):
    own = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS, 10**6)] + [(None, "no id"), (None, "no id"), (10**6, "same id")], "doc_id long, text string")
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(own)


def key(r):
    return (str(r[0]), str(r[1]))


def test_counts_are_those_of_the_library(docs, pieces, unigram):
    got = token_counts.count_tokens(docs.selectExpr("*", "1 AS n_tokens"), pieces).select("doc_id", "n_tokens").collect()
    want = [(r.doc_id, len(unigram.encode(r.text or ""))) for r in docs.collect()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_counts_do_not_depend_on_what_is_kept(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 2)
    few = token_counts.CountingTrie(pieces)
    many = ["▁one", "▁two", "▁one", "▁three", "▁on"]
    parts = [few.total([w]) for w in many]
    assert sum(parts) == token_counts.CountingTrie(pieces).total(many)


@pytest.mark.parametrize("frequent", [0, 50, 10**6])
def test_the_lattice_is_the_librarys_and_comes_back(docs, pieces, unigram, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    encoded = lattice.encode(docs.selectExpr("*", "1 AS row", "2 AS word"), pieces).persist()
    want = [(r.doc_id, None if r.text is None else unigram.encode(r.text)) for r in docs.collect()]
    assert sorted(map(tuple, encoded.collect()), key=key) == sorted(want, key=key)
    back = lattice.decode(encoded, pieces).collect()
    assert sorted(map(tuple, back), key=key) == sorted(map(tuple, docs.collect()), key=key)
    encoded.unpersist()


def test_the_query_decodes_each_row(spark, sf, pieces):
    rows = queries.op3_sentencepiece(spark, sf).collect()
    assert len(rows) == 200 and all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    own = spark.createDataFrame([*enumerate(TEXTS), (90, "its own \u2581 sign"), (None, "no id")], "doc_id long, text string")
    got = {r.doc_id: r.round_trip for r in lattice.encode_and_decode(own, pieces).collect()}
    assert got == {**{i: True for i in range(len(TEXTS))}, 90: False, None: True}


def test_one_python_step_behind_the_join_and_a_word_sent_once_by_a_task(spark, pieces, monkeypatch):
    """Each step has a worker of its own on every core, so decoding goes with the step that puts the ids together."""
    monkeypatch.setattr(lattice, "FREQUENT", 0)
    asked, solve = [], lattice.solve

    def counted(distinct, *more):
        asked.append(sorted(r.word for r in distinct.collect()))
        return solve(distinct, *more)

    monkeypatch.setattr(lattice, "solve", counted)
    own = spark.createDataFrame([(i, "some words twice some words") for i in range(50)], "doc_id long, text string").coalesce(1)
    out = lattice.encode_and_decode(own, pieces)
    assert asked[-1] == ["▁some", "▁twice", "▁words"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and plan.index("MapInArrow") < plan.index("Join")
    assert [r.round_trip for r in out.collect()] == [True] * 50


def test_no_rows(nothing, pieces):
    assert token_counts.count_tokens(nothing, pieces).count() == 0
    assert lattice.encode(nothing, pieces).count() == 0


def test_word_numbers_keep_their_order():
    import numpy as np

    codes = np.array([0, 5, 65534, 65535, 70000, 4_000_000_000, 1], np.uint32)
    assert (lattice._unpack(lattice._pack(codes)) == codes).all() and len(lattice._unpack(lattice._pack(codes[:0]))) == 0


def test_words_are_folded_by_bucket_and_not_collected_into_rows(spark, pieces, unigram):
    """Edges of a word are not collected into a row, and its fold does not copy all positions before; long words and unknown characters come out whole."""
    long = "".join(chr(97 + i * i * 7 % 26) for i in range(5_000)) + "\U0001f600" + "\u65e5" * 3
    own = spark.createDataFrame([(1, long), (2, "a " + long[:500]), (3, "short")], "doc_id long, text string")
    seen = lattice.solve(lattice.by_bucket(own.selectExpr("text AS word")), lattice.piece_frame(spark, pieces), pieces)
    assert "collect_list" not in seen._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.ids, r.round_trip) for r in lattice.encode_and_decode(own, pieces).collect()}
    assert got == {r.doc_id: (unigram.encode(r.text), True) for r in own.collect()}
