"""Line deduplication by pairwise alignment: blocks of lines that a document shares with an earlier one are deleted.

`block_lines` is the whole job and what the queries use. Copies are grouped by the digest of all their lines. Among the other documents each run of
just enough words names the first document that holds it, so pairs grow with lines and not with the square of a run's documents. A pair is aligned by patience diff over all lines that both hold. A run that an earlier document holds and that these
pairs left, because blocks cross or repeat in them, then meets the earlier holders with the fewest shared lines, where least can cross. What is still left meets
all earlier holders, one of each class: holders that agree in all lines of the documents that a run is left in are aligned alike, so the first of them
stands for all. So the lines that go are those that an alignment with every earlier document deletes.

`common_lines` is an older and narrower rule: a line names the first document that holds it, and a pair is aligned only over the lines that
the partner was the first to hold, so a block whose lines have several first holders is broken.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from trialweave.llm.names import fresh
from trialweave.llm.workers import lean
from trialweave.session import cut_lineage

#: Numbers of shared lines, and of repeats among them, that are told apart where the holders with the fewest are looked for.
LINE_COUNTS = 64
LINE_END = r"\r\n|\r|\n"


def patience(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned positions of two lists of (position, line hash), in order. Equal lines at both ends are taken, lines that are
    unique in both lists are anchors (their longest increasing run), and the gaps between anchors are aligned the same way."""
    matches: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a_low, a_high, b_low, b_high = work.pop()
        while a_low < a_high and b_low < b_high and a[a_low][1] == b[b_low][1]:
            matches.append((a[a_low][0], b[b_low][0]))
            a_low, b_low = a_low + 1, b_low + 1
        while a_low < a_high and b_low < b_high and a[a_high - 1][1] == b[b_high - 1][1]:
            a_high, b_high = a_high - 1, b_high - 1
            matches.append((a[a_high][0], b[b_high][0]))
        if a_low >= a_high or b_low >= b_high:
            continue
        in_a = Counter(a[i][1] for i in range(a_low, a_high))
        in_b = Counter(b[j][1] for j in range(b_low, b_high))
        at_b = {b[j][1]: j for j in range(b_low, b_high) if in_b[b[j][1]] == 1}
        anchors = _increasing([(i, at_b[a[i][1]]) for i in range(a_low, a_high) if in_a[a[i][1]] == 1 and a[i][1] in at_b])
        if not anchors:
            continue
        a_from, b_from = a_low, b_low
        for i, j in anchors:
            work.append((a_from, i, b_from, j))
            matches.append((a[i][0], b[j][0]))
            a_from, b_from = i + 1, j + 1
        work.append((a_from, a_high, b_from, b_high))
    return sorted(matches)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both parts, by piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[pile], at[pile] = j, k
        back.append(at[pile - 1] if pile else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common_blocks(a: list[tuple[int, int]], b: list[tuple[int, int]], lengths: dict[int, int], least_words: int) -> list[int]:
    """Positions of a in aligned runs without a gap in either document that hold at least `least_words` words."""
    out: list[int] = []
    run: list[int] = []
    last = None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if sum(lengths[x] for x in run) >= least_words:
                out += run
            run = []
        run.append(i)
        last = (i, j)
    return out


def _windows(hashes: list[int], words: list[int], least_words: int, gone: set[int] = frozenset()) -> set[int]:
    """Hashes of the shortest runs of lines from each line on, and up to each line, that hold at least `least_words` words and not only lines that are `gone`.
    Every line of a block of that many words lies in such a run inside the block."""
    out = set()
    for begin in range(len(hashes)):
        for steps in (range(begin, len(hashes)), range(begin, -1, -1)):
            held = 0
            for end in steps:
                held += words[end]
                if held >= least_words:
                    if gone and all(x in gone for x in range(min(begin, end), max(begin, end) + 1)):
                        break
                    run = 0
                    for x in hashes[min(begin, end) : max(begin, end) + 1]:
                        run = (run * 0x9E3779B97F4A7C15 + x) & 0xFFFFFFFFFFFFFFFF
                    out.add(run - (1 << 63))
                    break
    return out


def block_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 5) -> DataFrame:
    """(key, lines): the numbers (from 0, blank lines counted) of the lines to delete from each later document."""
    kind = docs.schema[key].dataType.simpleString()
    forms = F.transform(
        F.split(F.col(text), LINE_END), lambda x, i: F.struct(F.trim(F.lower(F.regexp_replace(x, r"\s+", " "))).alias("form"), i.alias("number"))
    )
    line = F.transform(
        F.filter(forms, lambda x: x["form"] != ""),
        lambda x: F.struct(F.xxhash64(x["form"]).alias("hash"), F.size(F.split(x["form"], " ")).alias("words"), x["number"].alias("number")),
    )
    rows = cut_lineage(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), line.alias("lines")))

    # A later copy goes as a whole. Rows that repeat a key with different texts are no copy.
    whole = rows.select("doc", F.xxhash64("lines.hash").alias("digest"), F.aggregate("lines.words", F.lit(0), lambda x, y: x + y).alias("words"), "lines.number")
    whole = whole.groupBy("doc").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"), F.first("words").alias("words"), F.first("number").alias("number"))
    whole = cut_lineage(whole.where(f"digest = other AND words >= {int(least_words)}").drop("other", "words"))
    heads = cut_lineage(whole.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("digest", "first"))
    copies = cut_lineage(whole.join(heads, "digest").where("doc <> first").select("doc", F.col("number").alias("lines")))
    rest = rows.join(copies.select("doc"), "doc", "left_anti")

    def runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [_windows(h, w, least_words) for h, w in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            at = [i for i, x in enumerate(found) for _ in x]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([x for f in found for x in f], pa.int64())], names=["doc", "run"])

    windows = cut_lineage(rest.select("doc", "lines.hash", "lines.words").mapInArrow(lean(runs), f"doc {kind}, run long"))
    shared = cut_lineage(windows.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("run", "first"))
    windows = cut_lineage(windows.join(shared, "run"))

    pairs = cut_lineage(windows.where("doc > first").select("doc", F.col("first").alias("partner")).distinct())

    # Grouped by document and line first: a line that very many documents hold then meets joins only, which AQE can split.
    numbered = rest.select("doc", F.posexplode("lines").alias("at", "line")).select("doc", "at", "line.*")
    places = cut_lineage(numbered.groupBy("doc", "hash").agg(F.sort_array(F.collect_set(F.struct("at", "number"))).alias("at"), F.first("words").alias("words")))
    held = cut_lineage(places.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("hash", "first"))
    lines = cut_lineage(places.join(held, "hash"))
    origin = lines.select(F.col("doc").alias("partner"), "hash", F.col("at.at").alias("first_at"))

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for shared in part.column(1).to_pylist():
                gone: set[int] = set()
                # A second time over the lines that the partner was the first to hold: they can cross where all lines together do not.
                for some in (shared, [c for c in shared if c["own"]]):
                    a = sorted((x["at"], c["hash"]) for c in some for x in c["at"])
                    b = sorted((j, c["hash"]) for c in some for j in c["first_at"])
                    lengths = {x["at"]: c["words"] for c in some for x in c["at"]}
                    number = {x["at"]: x["number"] for c in some for x in c["at"]}
                    gone.update(number[i] for i in _common_blocks(a, b, lengths, least_words))
                    if len(gone) == len(lengths):
                        break
                found.append(sorted(gone))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc", "lines"])

    def found_in(pairs: DataFrame) -> DataFrame:
        both = cut_lineage(pairs.join(lines, "doc")).join(origin, ["partner", "hash"])
        common = both.groupBy("doc", "partner").agg(F.collect_list(F.struct("hash", "at", "first_at", "words", F.expr("first = partner").alias("own"))).alias("common"))
        out = common.select("doc", "common").mapInArrow(lean(align), f"doc {kind}, lines array<int>").where(F.size("lines") > 0)
        return cut_lineage(out.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines")))

    def left(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = [part.column(c).to_pylist() for c in range(1, 5)]
            found = [_windows(h, w, least_words, {k for k, x in enumerate(n) if x in gone}) for h, w, n, gone in zip(*columns[:3], map(set, columns[3]))]
            at = [i for i, x in enumerate(found) for _ in x]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([x for f in found for x in f], pa.int64())], names=["doc", "run"])

    def open_runs(later: DataFrame, aligned: DataFrame) -> DataFrame:
        """(doc, run): the runs that an earlier document holds and that have a line left."""
        gone = aligned.select("doc", F.col("lines").alias("gone"))
        kept = rest.join(later, "doc", "left_semi").join(gone, "doc", "left")
        kept = kept.select("doc", "lines.hash", "lines.words", "lines.number", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
        runs = kept.mapInArrow(lean(left), f"doc {kind}, run long").distinct()
        return cut_lineage(runs.join(shared.select("run", "first"), "run").where("doc > first").select("doc", "run"))

    def fewest_lines(runs: DataFrame, holders: DataFrame) -> DataFrame:
        """(doc, partner): the earlier holders of each run with the fewest shared lines, one for each number of repeats among these lines."""
        sizes = lines.groupBy("doc").agg(F.least(F.count("*"), F.lit(LINE_COUNTS)).alias("size"), F.least(F.sum(F.size("at") - 1), F.lit(LINE_COUNTS)).alias("repeats"))
        firsts = holders.join(sizes, "doc").groupBy("run", "repeats", "size").agg(F.min("doc").alias("partner"))
        met = runs.join(firsts, "run").where("doc > partner")
        return met.groupBy("doc", "run", "repeats").agg(F.min(F.struct("size", "partner")).alias("best")).select("doc", F.col("best.partner").alias("partner")).distinct()

    def of_each_class(runs: DataFrame, holders: DataFrame) -> DataFrame:
        """(doc, partner): the first of the earlier holders that agree in what `align` reads of them, for all documents that the run is left in."""
        read = runs.join(lines, "doc").select("run", "hash").distinct()
        parts = holders.join(lines, "doc").join(read, ["run", "hash"]).select("run", "doc", "hash", (F.col("first") == F.col("doc")).alias("own"), F.explode("at.at").alias("at"))
        order = parts.groupBy("run", "doc").agg(F.sort_array(F.collect_list(F.struct("at", "hash", "own"))).alias("order"))
        steps = F.transform("order", lambda x, i: F.struct(x["hash"], x["own"], F.coalesce(x["at"] == F.get("order", i - 1)["at"] + 1, F.lit(False))))
        firsts = order.select("run", "doc", F.xxhash64(steps).alias("class")).groupBy("run", "class").agg(F.min("doc").alias("partner"))
        return runs.join(firsts, "run").where("doc > partner").select("doc", "partner").distinct()

    aligned, tried = found_in(pairs), pairs
    later = windows.where("doc > first").select("doc").distinct()
    for choose in (fewest_lines, of_each_class):
        runs_left = open_runs(later, aligned)
        holders = windows.select("doc", "run").join(runs_left.select("run").distinct(), "run", "left_semi")
        chosen = cut_lineage(choose(runs_left, holders))
        more = cut_lineage(chosen.join(tried, ["doc", "partner"], "left_anti"))
        if more.isEmpty():
            continue
        both = aligned.unionByName(found_in(more))
        aligned = cut_lineage(both.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines")))
        tried, later = tried.unionByName(more), runs_left.select("doc").distinct()
    return aligned.unionByName(copies).withColumnRenamed("doc", key)


def common_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 5) -> DataFrame:
    """(key, lines): the numbers (from 0, blank lines counted) of the lines to delete from each later document."""
    line = F.trim(F.lower(F.regexp_replace("line.text", r"\s+", " ")))
    numbered = (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).alias("doc"), F.transform(F.split(F.col(text), LINE_END), lambda x, i: F.struct(x.alias("text"), i.alias("number"))).alias("lines"))
        .select("doc", F.posexplode(F.filter("lines", lambda x: F.trim(x["text"]) != "")).alias("at", "line"))
        .select("doc", "at", "line.number", F.xxhash64(line).alias("hash"), F.size(F.split(line, " ")).alias("words"))
    )
    # Grouped by document and line first: a line that very many documents hold then meets joins only, which AQE can split.
    places = numbered.groupBy("doc", "hash").agg(F.sort_array(F.collect_list(F.struct("at", "number"))).alias("at"), F.first("words").alias("words"))
    places = cut_lineage(places)
    held = cut_lineage(places.groupBy("hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last").select("hash", "first"))
    lines = cut_lineage(places.join(held, "hash"))
    origin = lines.where("doc = first").select("hash", F.col("at.at").alias("first_at"))
    later = lines.where("doc <> first").join(origin, "hash")
    pairs = later.groupBy("doc", "first").agg(F.collect_list(F.struct("hash", "at", "first_at", "words")).alias("common"))

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for common in part.column(1).to_pylist():
                a = sorted((x["at"], c["hash"]) for c in common for x in c["at"])
                b = sorted((j, c["hash"]) for c in common for j in c["first_at"])
                lengths = {x["at"]: c["words"] for c in common for x in c["at"]}
                number = {x["at"]: x["number"] for c in common for x in c["at"]}
                found.append([number[i] for i in _common_blocks(a, b, lengths, least_words)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc", "lines"])

    kind = docs.schema[key].dataType.simpleString()
    aligned = pairs.select("doc", "common").mapInArrow(lean(align), f"doc {kind}, lines array<int>").where(F.size("lines") > 0)
    return aligned.groupBy("doc").agg(F.flatten(F.collect_list("lines")).alias("lines")).withColumnRenamed("doc", key)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, lines: pd.Series) -> pd.Series:
    """The texts without the given lines; nothing left but white space becomes empty."""

    def keep(t: str | None, gone) -> str | None:
        if t is None or gone is None:
            return t
        gone = set(gone)
        left = "\n".join(x for i, x in enumerate(re.split(LINE_END, t)) if i not in gone)
        return "" if left.isspace() else left

    return pd.Series([keep(t, g) for t, g in zip(text, lines)], dtype=object)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = 5, find: Callable[..., DataFrame] = common_lines) -> DataFrame:
    """The documents, same columns and rows, with common blocks deleted from the later document of each pair, and `deleted_lines` (int).

    Later means a larger key. A block is a run of aligned lines, consecutive in both documents but for blank lines, of at
    least `least_words` words; lines are compared in lower case with single spaces. `find` is `block_lines`, or the narrower `common_lines`. With `block_lines` a copy of
    that many words keeps nothing and has an empty text. Rows that
    repeat a key are one document to each other. Rows with a null key have no order and stay as they are, as do null and empty texts. A column that is
    already called deleted_lines is replaced. Line ends become \\n where lines are deleted.
    """
    kept = docs.select(*[c for c in docs.columns if c != "deleted_lines"])
    later, gone = fresh(kept, "later", "gone")
    found = find(docs, key, text, least_words).select(F.col(key).alias(later), F.col("lines").alias(gone))
    # The lines grow with the texts, so they are never sent to every task: one plan at every size, without a sort of the texts.
    out = kept.join(found.hint("shuffle_hash"), F.col(key) == F.col(later), "left")
    return out.withColumn(text, _kept(F.col(text), F.col(gone))).select(
        *kept.columns, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias("deleted_lines")
    )
