"""Spelling variants: words one edit apart, found by dynamic programming over a sorted vocabulary.

A pair of words at one edit, the shorter one of m code points, has its edit inside one of two windows of positions, [0, m / 2) or [m / 2, m), and agrees
outside. So a word goes to the groups (m, window, what is before, what is behind) for m its own length and one less, and only what lies inside the window
is compared. A group's sorted list is scanned for all its queries at once, depth by depth: words that share a prefix, by the common prefixes of
neighbours in the list, share one banded row of the edit matrix, and a range whose row exceeds one edit is left out with all its words. A group
with too many words is split: its window is halved and what moves out of it joins the key, until the windows are so narrow that the alphabet bounds the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from trialweave.session import cut_lineage

#: Runs of letters. Fixed value.
LETTERS = "A-Za-zÀ-ÿ"
#: Code points of a group's windows above which it is split, of a batch that is compared at once, and queries at once.
CELLS, BATCH_CELLS, QUERIES = 1 << 16, 1 << 21, 1 << 13
_KEY = ["m", "lo", "hi", "before", "behind"]


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case, one code point less where 31 divides the CRC of `<key>:<run>`, that occur `least_count` times.

    Rows without a key lose no code point; null texts have no runs.
    """
    # Runs shorter than the least length cannot reach it, and a greedy match is the whole run.
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{int(least_length)},}}"), F.lit(0)))
    found = docs.select(F.col(key).cast("string").alias("id"), run.alias("run"))
    found = found.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    found = found.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), F.col("run")), "UTF-8")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = found.select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _grouped(vocabulary: DataFrame) -> DataFrame:
    """Each word in its groups: (key, inner, extra, n); inner is what lies in the window, extra whether the word has m + 1 code points."""
    length = F.length("word")
    own, shorter = length, length - 1
    windows = [F.struct(m.alias("m"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for m in (own, shorter) for lo, hi in ((F.lit(0), F.floor(m / 2)), (F.floor(m / 2), m))]
    rows = vocabulary.where(length > 0).select("word", "n", F.explode(F.array(*windows)).alias("w")).select("word", "n", "w.*").where("lo < hi")
    extra = F.length("word") - F.col("m")
    return rows.select(
        "m", "lo", "hi",
        F.substring("word", F.lit(1), F.col("lo")).alias("before"),
        F.substring("word", F.col("hi") + extra + 1, F.length("word")).alias("behind"),
        F.substring("word", F.col("lo") + 1, F.col("hi") - F.col("lo") + extra).alias("inner"),
        (extra == 1).alias("extra"),
        "n",
    )


def _halved(rows: DataFrame) -> DataFrame:
    """The rows with each window halved; what leaves it joins the key."""
    wide = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    extra = F.col("extra").cast("int")
    left = F.struct(
        F.col("lo").alias("lo"), (F.col("lo") + wide).alias("hi"), F.col("before").alias("before"),
        F.concat(F.substring("inner", wide + extra + 1, F.length("inner")), "behind").alias("behind"), F.substring("inner", F.lit(1), wide + extra).alias("inner"),
    )
    right = F.struct(
        (F.col("lo") + wide).alias("lo"), F.col("hi").alias("hi"), F.concat("before", F.substring("inner", F.lit(1), wide)).alias("before"),
        F.col("behind").alias("behind"), F.substring("inner", wide + 1, F.length("inner")).alias("inner"),
    )
    return rows.select("m", "extra", "n", F.explode(F.array(left, right)).alias("w")).select("m", "w.lo", "w.hi", "w.before", "w.behind", "w.inner", "extra", "n")


def _bounded_groups(vocabulary: DataFrame, cells: int) -> DataFrame:
    """The grouped words, with the windows of crowded groups halved until each group has at most `cells` code points or a window of one position."""
    rows, done = cut_lineage(_grouped(vocabulary)), None
    while True:
        crowded = rows.where("hi - lo > 1").groupBy(*_KEY).agg(F.sum(F.length("inner")).alias("size")).where(F.col("size") > cells).select(*_KEY)
        crowded = cut_lineage(crowded)
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(crowded, _KEY, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        rows = cut_lineage(_halved(rows.join(crowded, _KEY, "left_semi")))


def scan(group: np.ndarray, inner: list[str], query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, other) of the pairs at exactly one edit within a group. Rows are sorted by group and by string; strings of a group are distinct.

    A frontier entry is a query, a range of rows that share a prefix of d code points, and the three entries of the edit matrix's
    row d that lie beside the diagonal (2 stands for more than one edit).
    """
    width = max(map(len, inner), default=0)
    if not width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.array(inner, f"U{width}").view(np.uint32).reshape(len(inner), width)
    lengths = np.fromiter(map(len, inner), np.int64, len(inner))
    differ = letters[1:] != letters[:-1]
    shared = np.where(group[1:] != group[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), width))
    of = np.cumsum(np.concatenate([[0], shared < 0])) if len(inner) else np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    asked = np.flatnonzero(query)
    for low in range(0, len(asked), QUERIES):
        q = asked[low : low + QUERIES]
        node = of[q]
        row = np.tile(np.array([[2], [0], [1]], np.int8), (1, len(q)))
        starts = np.flatnonzero(np.concatenate([[True], shared < 0]))
        for depth in range(width + 1):
            first = starts[node]
            beside = lengths[q] - depth + 1
            at_end = np.flatnonzero((lengths[first] == depth) & (beside >= 0) & (beside <= 2))
            hit = at_end[row[beside[at_end], at_end] == 1]
            found.append((q[hit], first[hit]))
            if depth == width:
                break
            below = np.flatnonzero(np.concatenate([[True], shared <= depth]))
            child = np.searchsorted(below, np.append(starts, len(inner)))
            many = np.diff(child)[node]
            parent = np.repeat(np.arange(len(q)), many)
            node = np.repeat(child[node] - np.cumsum(many) + many, many) + np.arange(len(parent))
            letter = letters[below[node], depth]
            q, above = q[parent], row[:, parent]
            row = np.full((3, len(q)), 2, np.int8)
            for k in range(3):
                j = depth + k
                if j >= 1:
                    same = letters[q, j - 1] == letter if j <= width else np.zeros(len(q), bool)
                    row[k] = np.minimum(row[k], above[k] + ~same)
                if k < 2:
                    row[k] = np.minimum(row[k], above[k + 1] + 1)
                if k:
                    row[k] = np.minimum(row[k], row[k - 1] + 1)
                row[k][j > lengths[q]] = 2
            near = np.flatnonzero((row.min(axis=0) <= 1) & (letter != 0))
            q, node, row, starts = q[near], node[near], row[:, near], below
            if not len(q):
                break
    return np.concatenate([x for x, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([y for _, y in found] or [np.zeros(0, np.int64)])


def _groups(table: pa.Table) -> np.ndarray:
    """The number of each row's group; rows are sorted by key."""
    fresh = np.zeros(table.num_rows, bool)
    for name in _KEY:
        key = table.column(name).combine_chunks()
        fresh[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(fresh)


def _pairs(table: pa.Table) -> pa.RecordBatch:
    """(word, near, near_n) for the pairs whose edit belongs to their group's window, in both directions."""
    group = _groups(table)
    crowd = np.bincount(group)
    inner = np.array(table.column("inner").to_pylist(), object)
    extra = table.column("extra").to_numpy()
    size = np.fromiter(map(len, inner), np.int64, len(inner))
    width = (table.column("hi").to_numpy() - table.column("lo").to_numpy()).astype(np.int64)
    last = table.column("hi").to_numpy() == table.column("m").to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Windows of like width are compared together, so that short ones are not padded to a long one.
    for kind in np.unique(np.frexp(width.astype(float))[1]):
        rows = np.flatnonzero((np.frexp(width.astype(float))[1] == kind) & (crowd[group] > 1))
        ends = np.append(np.flatnonzero(np.diff(group[rows], append=-1)) + 1, 0) if len(rows) else np.zeros(1, np.int64)
        at, most = 0, max(1, BATCH_CELLS >> int(kind))
        while at < len(rows):
            end = ends[:-1][max(np.searchsorted(ends[:-1], at + most, side="right") - 1, np.searchsorted(ends[:-1], at, side="right"))]
            part = rows[at:end]
            q, t = scan(group[part], list(inner[part]), ~extra[part])
            q, t = part[q], part[t]
            # The last position at which the longer word can have its extra code point is the length of the common prefix; equal lengths differ inside.
            inside = np.array([not y.startswith(x) for x, y in zip(inner[q], inner[t])], bool)
            kept = inside | last[q] | (size[q] == size[t])
            left.append(q[kept])
            right.append(t[kept])
            at = end
    q, t = np.concatenate(left), np.concatenate(right)
    both = extra[t]
    word = pc.binary_join_element_wise(table.column("before").combine_chunks(), table.column("inner").combine_chunks(), table.column("behind").combine_chunks(), "")
    one, other = pa.array(np.concatenate([q, t[both]])), pa.array(np.concatenate([t, q[both]]))
    return pa.RecordBatch.from_arrays([word.take(one), word.take(other), table.column("n").combine_chunks().take(other)], names=["word", "near", "near_n"])


def _search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups are compared as they arrive in order; the last group of what has arrived waits for its next rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows < 1 << 15:
            continue
        table = pa.Table.from_batches(held)
        group = _groups(table)
        end = int(np.searchsorted(group, group[-1]))
        if end:
            yield _pairs(table.slice(0, end))
        held = table.slice(end).to_batches()
        rows -= end
    if rows:
        yield _pairs(pa.Table.from_batches(held))


def near_words(vocabulary: DataFrame, cells: int = CELLS) -> DataFrame:
    """(word, near, near_n): both directions of each pair of words of (word, n) that differ by exactly one inserted, deleted or replaced code point, once.

    Words must be distinct and not null; those of no code point take part in no pair. Every pair is found, whatever its length.
    """
    rows = _bounded_groups(vocabulary, cells).repartition(*_KEY).sortWithinPartitions(*_KEY, "inner")
    return rows.mapInArrow(_search, "word string, near string, near_n long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms lead to. Steps double, and each form is more frequent than its word, so rounds are few."""
    reached = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut_lineage(reached.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        reached = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return reached


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `words`.

    The form is the near word with the largest n (ties: the smallest in code-point order) if that is at least `factor` times the word's n, else
    null, and form_n its n; the root is where forms lead from the word, the word itself if it has none; n_near counts the near words. Repeated rows count
    as often as they occur, null and empty texts have no words, and other columns are not read. No texts or no such words: no rows.
    """
    vocabulary = cut_lineage(words(docs, key, text, least_length, least_count))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = vocabulary.join(near, "word", "left").withColumn("good", -F.col("best.less") >= F.lit(factor) * F.col("n"))
    known = cut_lineage(
        known.select("word", F.expr("if(good, best.near, null)").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(good, -best.less, null)").alias("form_n"))
    )
    roots = _roots(known.where("form IS NOT NULL"))
    out = known.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
