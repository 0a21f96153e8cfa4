"""Benchmark decontamination: passages of documents within a small word edit distance of a benchmark item.

A window of a document and a window of an item are embedded by a CGK random walk: at step j the walk emits the word under its
pointer and moves on by a random bit that depends on j and the word, so few edits become few differing steps. A
repetition samples some steps; windows whose sampled steps agree are candidates, and as many repetitions with walks and samples of their
own are made as reach the target recall in simulated windows at the edit bound. Candidates are decided by the exact edit distance of the whole item.

Windows start at every word and are as long as the items of a length class; those of items of `SPLIT` words and more are a whole part of that length, so
that one of the parts that lie side by side has its share of the allowed edits at most. Before the walk a window must share as many runs of
three words (of two for the shortest items) with the items of its class as that share leaves in place, and lie in a window as long as the class
that does the same for all allowed edits, which loses no match.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trialweave.llm import words
from trialweave.llm.workers import lean

#: Benchmark bytes that go to every task at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20
#: Sampled steps of a repetition, the share of simulated matches that become candidates, simulated matches of a class, and the most repetitions.
SAMPLED, RECALL, SIMULATED, MOST_REPETITIONS = 3, 0.99, 1000, 96
#: Items of so many words and more are found by windows of a part of their length, each of at least half as many words.
SPLIT = 24
#: Text bytes that a task works on at once, and windows times repetitions that are walked at once.
SLICE_BYTES, WALK_CELLS = 2 << 20, 1 << 16


@dataclass(frozen=True)
class Rule:
    """Items with fewer than `least_words` words are not searched; an item of n words matches within floor(n * edits) word edits."""

    least_words: int = 5
    edits: float = 0.2

    def allowed(self, n: int) -> int:
        return int(n * self.edits + 1e-9)

    def window(self, n: int) -> int:
        """Window length of the class of items of n words: 5, 6, 7, 8, 10, 12, 15, 18, ..., each about a quarter longer."""
        length = self.least_words
        while (longer := self.next_window(length)) <= n:
            length = longer
        return length

    def searched(self, n: int) -> tuple[int, int]:
        """Window length for items of n words, and the most edits of the best of the windows that lie side by side in such an item."""
        low = self.window(n)
        parts = max(1, low // (SPLIT // 2)) if low >= SPLIT else 1
        return low // parts, self.allowed(self.next_window(low) - 1) // parts

    @staticmethod
    def next_window(length: int) -> int:
        return max(length + 1, length * 5 // 4)


@lru_cache(maxsize=None)
def repetitions(length: int, edits: int) -> int:
    """The fewest repetitions that make `RECALL` of simulated windows of distinct words with that many word edits a candidate; an error where `MOST_REPETITIONS` do not."""
    draw = np.random.default_rng((length, edits))
    texts = []
    for _ in range(SIMULATED):
        item = draw.integers(0, 1 << 63, length, dtype=np.uint64)
        changed = item.tolist()
        for at in sorted(draw.choice(length, edits, replace=False).tolist(), reverse=True):
            kind = draw.integers(0, 3)  # a replaced, a deleted or an inserted word
            changed[at : at + (kind < 2)] = [] if kind == 1 else [int(draw.integers(0, 1 << 63))]
        changed += draw.integers(0, 1 << 63, length, dtype=np.uint64).tolist()  # the words behind the passage
        texts += [item, np.array(changed[:length], np.uint64)]
    starts = np.arange(2 * SIMULATED) * length
    found = _walks(np.concatenate(texts), starts, starts + length, length, MOST_REPETITIONS)
    recall = np.maximum.accumulate(found[:, ::2] == found[:, 1::2], axis=0).mean(axis=1)
    if recall[-1] < RECALL:
        raise ValueError(f"{MOST_REPETITIONS} repetitions find {recall[-1]:.3f} of windows of {length} words with {edits} edits, not {RECALL}: allow fewer edits")
    return int(np.argmax(recall >= RECALL)) + 1


def _walks(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, repeated: int) -> np.ndarray:
    """(repetitions, windows): the signature of each window in each repetition, from the sampled steps of its walk of 2 * length steps.

    A repetition walks up to its last sampled step only, and windows are walked in chunks of bounded size. The random bit of a step is the
    top bit of the word's hash times an odd number of that step.
    """
    draw = np.random.default_rng(length)
    sampled = np.zeros((repeated, 2 * length), bool)
    odd, salts = np.empty((2, repeated, 2 * length), np.uint64)
    for i, repetition in enumerate(sampled):
        repetition[draw.choice(2 * length, SAMPLED, replace=False)] = True
        odd[i] = draw.integers(0, 1 << 63, 2 * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salts[i] = draw.integers(0, 1 << 63, 2 * length, dtype=np.uint64)
    ends_at = 2 * length - np.argmax(sampled[:, ::-1], axis=1)  # steps of each repetition
    order = np.argsort(-ends_at, kind="stable")
    sampled, odd, salts, ends_at = sampled[order], odd[order], salts[order], ends_at[order]
    out = np.empty((repeated, len(starts)), np.uint64)
    step = max(1, WALK_CELLS // max(1, repeated))
    last = len(values) - 1
    for low in range(0, len(starts), step):
        at = np.repeat(starts[None, low : low + step], repeated, axis=0)
        stop = ends[low : low + step]
        signature = np.full(at.shape, length, np.uint64)
        for j in range(int(ends_at[0])):
            walking = int(np.searchsorted(-ends_at, -j))  # repetitions with more than j steps
            here = at[:walking]
            word = np.where(here < stop, values[np.minimum(here, last)], np.uint64(0))
            for i in np.flatnonzero(sampled[:walking, j]):
                signature[i] = words.mix(signature[i] * np.uint64(0x9E3779B97F4A7C15) + word[i])
            here += ((word * odd[:walking, j, None] + salts[:walking, j, None]) >> np.uint64(63)).astype(np.int64)
        out[order, low : low + step] = signature
    return out


def edit_distance(item: np.ndarray, region: np.ndarray, anchored: bool = False) -> tuple[int, int]:
    """Least word edits that turn the item into a part of the region, and the end of that part. `anchored`: a part from the start."""
    steps = np.arange(len(region) + 1)
    row = steps.copy() if anchored else np.zeros(len(region) + 1, np.int64)
    for word in item:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


class Benchmark:
    """Word hashes of a block of items, their pairs, and the signatures of their windows."""

    def __init__(self, ids: list, texts: list[str], rule: Rule) -> None:
        self.rule, self.ids, self.items = rule, [], []
        for low, high, values, firsts in words.hashed_words(pa.array(texts, pa.string()), words.MARKS):
            for i in range(high - low):
                if firsts[i + 1] - firsts[i] >= rule.least_words:
                    self.ids.append(ids[low + i])
                    self.items.append(values[firsts[i] : firsts[i + 1]].copy())
        self.words = [x.tolist() for x in self.items]
        self.classes = {}
        for whole in sorted({rule.window(len(x)) for x in self.items}):
            mine = [i for i, x in enumerate(self.items) if rule.window(len(x)) == whole]
            length, spoilt = rule.searched(whole)
            item = np.concatenate([np.full(len(self.items[i]) - length + 1, i) for i in mine])
            offset = np.concatenate([np.arange(len(self.items[i]) - length + 1) for i in mine])
            lengths = np.array([len(x) for x in self.items])
            begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            starts = begins[item] + offset
            values = np.concatenate(self.items)
            filters = []
            for of, lost in dict.fromkeys([(whole, rule.allowed(rule.next_window(whole) - 1)), (length, spoilt)]):
                run = 3 if of - 2 - 3 * lost >= 2 else 2
                runs = np.concatenate([words.chained(self.items[i], run) for i in mine])
                mask = np.uint64((1 << max(16, (64 * len(runs)).bit_length())) - 1)
                known = np.zeros(int(mask) + 1, bool)
                known[runs & mask] = True
                filters.append((of, lost, run, mask, known))
            tables = []
            for signature in _walks(values, starts, starts + length, length, repetitions(length, spoilt)):
                order = np.argsort(signature, kind="stable")
                tables.append((signature[order], item[order], offset[order]))
            self.classes[whole] = (length, filters, tables)

    def hits(self, values: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, words, distance) of every matching passage, each once, in order."""
        n = len(values)
        if n == 0 or not self.items:
            return []
        row_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        row_end = firsts[1:][row_of]
        at, found = np.arange(n), set()
        chained = {run: words.chained(values, run) for run in {f[2] for c in self.classes.values() for f in c[1]}}
        for length, filters, tables in self.classes.values():
            passed = np.ones(n, bool)
            for of, lost, run, mask, known in filters:
                running = np.zeros(n + 1, np.int32)
                inside = max(0, n - run + 1)
                running[1 : inside + 1] = np.cumsum(known[chained[run] & mask], dtype=np.int32)
                running[inside + 1 :] = running[inside]
                ends = np.minimum(at + of, row_end)
                shared = running[np.maximum(ends - run + 1, at)] - running[:-1]
                mine = (shared >= max(1, of - run + 1 - run * lost)) & (ends - at >= of - lost)
                if of > length:  # a part can begin wherever it ends within the whole window and the words put into it
                    before = np.concatenate([[0], np.cumsum(mine)])
                    mine = before[1:] > before[np.maximum(at - (of - length + lost), 0)]
                passed &= mine
            starts = np.flatnonzero(passed)
            if not len(starts):
                continue
            longest = max(len(x) for x in self.items)
            candidates = []
            for mine, (signatures, item, offset) in zip(_walks(values, starts, ends[starts], length, len(tables)), tables):
                low, high = np.searchsorted(signatures, mine, "left"), np.searchsorted(signatures, mine, "right")
                alike = high - low
                s = np.repeat(starts, alike)
                at_table = np.arange(len(s)) + np.repeat(low - np.cumsum(alike) + alike, alike)
                candidates.append(np.unique((row_of[s] * len(self.items) + item[at_table]) * (n + longest) + s - offset[at_table] + longest))
            number, begin = np.divmod(np.unique(np.concatenate(candidates)), n + longest)
            found |= self._verified(values, firsts, zip(*(x.tolist() for x in (*np.divmod(number, len(self.items)), begin - longest))))
        return sorted(found)

    def _verified(self, values: np.ndarray, firsts: np.ndarray, candidates: Iterable[tuple[int, int, int]]) -> set:
        """Exact matches near candidates (row, item, first word of the item), in order; candidates a few words apart are one region."""
        found, done = set(), (-1, -1, 0)
        for row, i, at in candidates:
            if done[:2] == (row, i) and at <= done[2]:
                continue
            item, begin, stop = self.items[i], int(firsts[row]), int(firsts[row + 1])
            allowed = self.rule.allowed(len(item))
            done = (row, i, at + allowed)
            low = max(begin, at - allowed)
            region = values[low : min(stop, at + len(item) + 2 * allowed)]
            there = set(region.tolist())
            if sum(word in there for word in self.words[i]) < len(item) - allowed:
                continue  # each word that the region lacks is an edit
            distance, end = edit_distance(item, region)
            if distance <= allowed:
                _, back = edit_distance(item[::-1], region[:end][::-1], anchored=True)
                found.add((row, i, low + end - back - begin, back, distance))
        return _apart(found)


def _apart(found: set[tuple[int, int, int, int, int]]) -> set[tuple[int, int, int, int, int]]:
    """Of passages of one item that overlap, the one with the least distance (then the first)."""
    kept: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
    for hit in sorted(found, key=lambda h: (h[4], h)):
        others = kept.setdefault(hit[:2], [])
        if all(hit[2] >= o[2] + o[3] or o[2] >= hit[2] + hit[3] for o in others):
            others.append(hit)
    return {hit for hits in kept.values() for hit in hits}


def _blocks(spark: SparkSession, benchmark: DataFrame, item: str, text: str, rule: Rule) -> Iterator:
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        yield spark.sparkContext.broadcast(Benchmark([r.i for r in mine], [r.t for r in mine], rule))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(key, item, start_word, n_words, distance): every passage of a document that matches a benchmark item.

    Words are runs of letters and digits, ASCII case folded; distance counts inserted, deleted and replaced words. Null and empty texts have no
    words and no hits; items that are null or too short match nothing; repeated rows give their own hits; an empty benchmark gives none.
    Only the named columns are read. Documents are scanned once for each block of the benchmark, without a shuffle.
    """
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = None
    for shared in _blocks(docs.sparkSession, benchmark, item, item_text, rule):

        def batches(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for part in parts:
                at, hits = [], []
                for low, _, values, firsts in words.hashed_words(part.column(1), words.MARKS, SLICE_BYTES):
                    new = known.hits(values, firsts)
                    at += [low + h[0] for h in new]
                    hits += [(known.ids[h[1]], *h[2:]) for h in new]
                columns = list(zip(*hits)) if hits else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], item_type), *[pa.array(c, pa.int32()) for c in columns[1:]]],
                    names=["key", "item", "start_word", "n_words", "distance"],
                )

        found = rows.mapInArrow(lean(batches), f"key {kind}, item {item_kind}, start_word int, n_words int, distance int")
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("key", key).withColumnRenamed("item", item)


def without_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of docs, all columns, that hold no passage of the benchmark; null and empty texts stay."""
    out = docs
    for shared in _blocks(docs.sparkSession, benchmark, item, item_text, rule):

        def batches(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for part in parts:
                keep = np.ones(len(part), bool)
                for low, _, values, firsts in words.hashed_words(part.column(part.schema.get_field_index(text)), words.MARKS, SLICE_BYTES):
                    keep[[low + h[0] for h in known.hits(values, firsts)]] = False
                yield part.filter(pa.array(keep))

        out = out.mapInArrow(lean(batches), docs.schema)
    return out
