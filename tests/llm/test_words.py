from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, strategies as st

from trialweave.llm import words

TEXTS = st.lists(st.none() | st.text(alphabet="aBb \t\nÉé😀,1", max_size=30), max_size=8)


@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    for separators, pattern in ((words.WHITE, r"[^\x20\x09-\x0D]+"), (words.MARKS, r"[A-Za-z0-9\x80-\U0010ffff]+")):
        got = []
        for low, high, hashed, firsts in words.hashed_words(pa.array(texts, pa.string()), separators, 16):
            got += [hashed[firsts[i] : firsts[i + 1]].tolist() for i in range(high - low)]
        lower = [re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in lower]
        one = {}
        for hashes, found in zip(got, lower):
            for h, w in zip(hashes, found):
                assert one.setdefault(w, h) == h
        assert len(set(one.values())) == len(one)


def test_a_sliced_column_and_a_long_text():
    column = pa.array(["skip", "a b", None, "c " * (words.SLICE_BYTES // 2 + 5), "b"]).slice(1)
    sizes = [n for _, _, _, firsts in words.hashed_words(column) for n in np.diff(firsts)]
    assert sizes == [2, 0, words.SLICE_BYTES // 2 + 5, 1]


def test_runs_of_words():
    values = np.arange(5, dtype=np.uint64)
    assert len(words.chained(values, 3)) == 3 and len(words.chained(values, 6)) == 0
    assert words.chained(values[1:], 2)[0] == words.chained(values, 2)[1]
