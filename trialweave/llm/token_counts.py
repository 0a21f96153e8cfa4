"""Token counts under a unigram piece table: one dynamic programme over the trie of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialweave.llm.pieces import PieceTable, pre_tokens

#: Pre-tokens whose counts a task keeps; beyond it the task starts anew, which costs time and changes no result.
KEPT = 500_000


class CountingTrie:
    """Counts of pre-tokens. New ones are walked in sorted order, which is the trie in depth-first order: the open path holds the
    best score and the piece count of each prefix, and a prefix shared with the pre-token before is not computed again."""

    def __init__(self, table: PieceTable) -> None:
        self.table, self.longest = table, table.longest
        self.scores = {p: s for p, (_, s) in table.pieces.items()}
        self.counts: dict[str, int] = {}

    def insert(self, new: list[str]) -> None:
        scores, longest, unknown = self.scores.get, self.longest, self.table.unknown_score
        best, used, before = [0.0], [0], ""
        for word in sorted(new):
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, top_used = None, 0
                for start in range(max(0, end - longest), end):
                    score = scores(word[start:end])
                    if score is not None and (top is None or best[start] + score > top):
                        top, top_used = best[start] + score, used[start] + 1
                if scores(word[end - 1]) is None and (top is None or best[end - 1] + unknown > top):
                    top, top_used = best[end - 1] + unknown, used[end - 1] + len(word[end - 1].encode())
                best.append(top)
                used.append(top_used)
            before = word
            self.counts[word] = used[-1]

    def total(self, words: list[str]) -> int:
        if len(self.counts) > KEPT:
            self.counts.clear()
        new = set(words).difference(self.counts)
        if new:
            self.insert(list(new))
        return sum(map(self.counts.__getitem__, words))


def count_tokens(docs: DataFrame, table: PieceTable, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_pre_tokens) for each row of docs.

    n_tokens is the number of pieces of the best segmentation; of equal scores the one whose last piece is longest counts.
    A character that is no piece counts as its UTF-8 bytes. Null and empty texts have 0 tokens. Repeated rows and null
    keys keep their own rows; other columns are not read. No shuffle: each task has its own trie of bounded size, and a
    lost task is computed again from its input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountingTrie(shared.value)
        for part in parts:
            tokens, words = [], []
            texts = part.column(1)
            for low in range(0, len(texts), 256):
                each = [pre_tokens(t) for t in texts[low : low + 256].to_pylist()]
                new = set().union(*each).difference(trie.counts)
                if len(trie.counts) <= KEPT and new:
                    trie.insert(list(new))
                tokens += [trie.total(w) for w in each]
                words += map(len, each)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], names=[key, "n_tokens", "n_pre_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(batches, f"`{key}` {kind}, n_tokens long, n_pre_tokens long")
