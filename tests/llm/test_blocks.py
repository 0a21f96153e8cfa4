"""Blocks of documents that send each rare word once, and segments of positions that reach the fold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from trialweave.llm import lattice
from trialweave.llm.pieces import PieceTable, load_pieces
from trialweave.llm.queries import PIECES


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(PIECES)


def part(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array([hash(t) for t in texts], pa.int64())], names=["key", "text", "row"])


def test_a_block_sends_each_rare_word_once_and_numbers_it(monkeypatch):
    monkeypatch.setattr(lattice, "_ROWS", 1)
    monkeypatch.setattr(lattice, "BLOCK_ROWS", 2)
    coder = lattice._Coder(pa.table({"word": ["▁often"], "ids": pa.array([b"\x01\x00\x00"])}))
    rows = part(["often rare rare", "rare often other", None, "", "often"])
    found = list(coder.blocks(rows, 4, spelled=True))
    assert [(low, high) for _, low, high, *_ in found] == [(0, 2), (2, 4), (4, 5)]
    _, _, _, codes, sizes, bucket, own = found[0]
    assert sorted(own) == [b" other", b" rare"] and sizes.tolist() == [3, 3] and (np.diff(bucket) >= 0).all()
    rare, other = 1 + own.index(b" rare"), 1 + own.index(b" other")
    assert codes.tolist() == [0, rare, rare, rare, 0, other]
    again = list(coder.blocks(rows, 4))
    assert [b[0] for b in again] == [b[0] for b in found] and len({b[0] for b in found}) == 3
    assert all((a[3] == b[3]).all() and (a[5] == b[5]).all() for a, b in zip(again, found))


@pytest.mark.parametrize("width", [2, 3])
def test_answers_keep_words_apart(width):
    ids, sizes = np.array([5, 0, 7, 0, 32767], np.int64), np.array([2, 1, 1, 1])
    back, back_sizes = lattice._own(lattice._closed(ids, sizes, width).tobytes(), width)
    assert back.tolist() == ids.tolist() and back_sizes.tolist() == sizes.tolist()
    assert [len(x) for x in lattice._own(b"", width)] == [0, 0]


def test_each_bucket_answers_a_block_in_its_order():
    places = pa.array([[{"block": 9, "at": 1}, {"block": 4, "at": 0}], [{"block": 9, "at": 0}]], pa.list_(pa.struct([("block", pa.int64()), ("at", pa.int32())])))
    got = lattice._answers(3, np.array([11, 12, 13]), np.array([2, 1]), places, 2).to_pylist()
    assert [(r["block"], r["bucket"]) for r in got] == [(4, 3), (9, 3)]
    assert [[x.tolist() for x in lattice._own(r["own"], 2)] for r in got] == [[[11, 12], [2]], [[13, 11, 12], [1, 2]]]


def test_the_longest_piece_of_a_position_brings_the_others():
    table = PieceTable({"a": (3, -1.0), "ab": (4, -2.0), "abcd": (6, -1.5), "xy": (5, -1.0)}, [0, 1, 2], -20.0, 0)
    flat, first, count = lattice._prefixes(table)
    edges = {i: [((w >> lattice._ID_BITS) & 63, w & lattice._UNKNOWN) for w in flat[first[i] : first[i] + count[i]].tolist()] for i in range(len(count))}
    assert edges[6] == [(1, 3), (2, 4), (4, 6)] and edges[5] == [(2, 5), (1, lattice._UNKNOWN)] and edges[7] == [(1, lattice._UNKNOWN)]


def test_few_rows_of_a_word_reach_the_fold(spark, pieces):
    """Positions travel in rows of `SEGMENT`; a row for each edge made the way to Python the largest part of the work."""
    word = "▁internationalisation"
    seen = lattice.solve(lattice.by_bucket(spark.createDataFrame([(word,)], "word string")), lattice.piece_frame(spark, pieces), pieces)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("Aggregate") < plan.index("Join")
    names, ids = lattice._names(pieces), lattice._ids(np.frombuffer(seen.first().ids, np.uint8))
    assert b"".join(names[int(i)].as_py() for i in ids).decode() == word.replace("▁", " ")


def test_many_blocks_repeated_rows_and_rows_of_a_shuffle(spark, pieces, monkeypatch):
    rows = [(i % 5000, f"Row {i % 5000} of rareword{i % 91} and\n  日{i % 3} more") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(lattice, "FREQUENT", 0)
    plain = lattice.encode_and_decode(docs, pieces).collect()
    assert len(plain) == 10_000 and all(r.round_trip for r in plain)
    dealt = lattice.encode_and_decode(docs.repartition(3), pieces).collect()
    monkeypatch.setattr(lattice, "FREQUENT", 10**6)
    known = lattice.encode_and_decode(docs, pieces).collect()
    assert sorted(plain) == sorted(dealt) == sorted(known)


def test_ids_that_are_no_utf8_and_ids_that_are_no_piece(pieces):
    names = lattice._names(pieces)
    high = pieces.bytes[0xE6]
    assert lattice._texts(pa.array([[high, high], None, []], pa.list_(pa.int32())), names).to_pylist() == ["�", None, ""]
    with pytest.raises((KeyError, IndexError)):
        lattice._texts(pa.array([[10**8]], pa.list_(pa.int32())), names)


def test_the_driver_gives_memory_back_once_its_tables_are_made(spark, pieces, monkeypatch):
    told, solve = [], lattice.solve
    monkeypatch.setattr(lattice, "solve", lambda *a: told.append("solve") or solve(*a))
    monkeypatch.setattr(lattice, "give_back", lambda: told.append("back"))
    lattice.encode(spark.createDataFrame([(1, "a few words")], "doc_id long, text string"), pieces)
    assert told == ["solve", "solve", "back"]
