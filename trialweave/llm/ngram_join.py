"""Similarity join on word n-grams: documents whose shingle sets have a Jaccard similarity of at least a bound.

Sets are banded by size so that sets of one band or of neighbouring bands hold every possible pair. In a band each set is dealt out,
by shingle hash, to more parts than a linked pair can have differing shingles; by the pigeonhole principle a linked pair has an
equal part, so a tile is (band, part, hash of the part) and pairs are looked for in tiles only. That loses nothing and
a tile holds near copies, however frequent single shingles are. Each set has a bitmap of its shingle hashes; the counts
of bits that one bitmap has and the other lacks bound the overlap from above, and what is left is decided by intersecting sorted arrays.

A tile is never expanded into its pairs. Members are first compared with the tile's smallest member; once those links have
been closed into components, only members outside the component of the tile's smallest member are compared with the members
of other components. A pair whose ends are already connected cannot change a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialweave.llm import words
from trialweave.llm.workers import lean
from trialweave.operators.components import components
from trialweave.session import cut_lineage

BITS = 1024
#: Parts beyond the differences that a pair can have, as a least number and a share: parts with few shingles, which frequent
#: shingles would fill alike in many sets, are left out while there are no more of them than these.
SPARE, SPARE_SHARE = 2, 0.15
#: Rows whose sketches a Python worker makes at once.
ROWS = 1024
#: First tiles of a set by which a pair's later meetings are known.
HEADS = 8
#: Ids that are broadcast to select documents; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_SEED = np.uint64(0xD6E8FEB86659FD93)


class Bands:
    """Size bands and the number of parts in each. `share` is the bound as (numerator, denominator)."""

    def __init__(self, share: tuple[int, int]) -> None:
        self.share = share
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * share[1] // share[0] + 1))
        self.starts_array = np.array(self.starts)

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.starts_array, size, side="right")) - 1

    def differing(self, band: int) -> int:
        """Most shingles in exactly one set of a linked pair whose larger set is in the band: with the overlap at least s x
        union and union + overlap at most twice the largest size, the union less the overlap is at most 2 r (1 - s) / (1 + s)."""
        top, (a, b) = self.starts[band + 1] - 1, self.share
        return 2 * top * (b - a) // (a + b)

    def spare(self, band: int) -> int:
        return max(SPARE, math.ceil(SPARE_SHARE * self.differing(band)))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles: words end at white space, A-Z is read as a-z. With fewer
    than n words the whole sequence is one shingle; without words, or for null, the set is empty."""
    for low, high, hashed, firsts in words.hashed_words(column):
        runs = words.chained(hashed, n)
        for i in range(high - low):
            start, end = firsts[i], firsts[i + 1]
            if end - start >= n:
                yield np.unique(runs[start : end - n + 1])
            else:
                yield words.chained(hashed[start:end], int(end - start)) if end > start else np.zeros(0, np.uint64)


def _class(shingles: np.ndarray) -> int:
    """Id of a set: a hash of all its members."""
    seed = words.mix(shingles + _SEED).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(words.mix(np.array([seed], np.uint64)).view(np.int64)[0])


def _bitmap(shingles: np.ndarray) -> list[int]:
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles >> np.uint64(32)) % np.uint64(BITS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def _tiles(shingles: np.ndarray, bands: Bands) -> np.ndarray:
    """Tile hashes of a set, in its own band and the next one up."""
    band, out = bands.of(len(shingles)), []
    members = words.mix(shingles ^ _SEED)
    for instance in (band, band + 1):
        differing = bands.differing(instance)
        if differing == 0:
            continue  # only equal sets can be linked
        spare = bands.spare(instance)
        parts = differing + 1 + spare
        part = (members % np.uint64(parts)).astype(np.int64)
        filled = np.bincount(part, minlength=parts)
        order = np.argsort(part, kind="stable")
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles[order] * np.uint64(0x9E3779B97F4A7C15), dtype=np.uint64)])
        ends = np.cumsum(filled)
        totals = running[ends] - running[ends - filled]
        least = next(n for n in (1, 0, -1) if (filled <= n).sum() <= spare)
        keep = np.flatnonzero(filled > least)
        out.append(words.mix(words.mix(totals[keep]) + keep.astype(np.uint64) * _SEED + np.uint64(instance << 1 | 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, key: str, text: str, n: int, bands: Bands) -> DataFrame:
    """(key, size, class, bitmap, tiles) for each row. Rows of a task with the same class after the first have neither bitmap nor tiles."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in (whole.slice(at, ROWS) for whole in parts for at in range(0, len(whole), ROWS)):
            sizes, classes, bitmaps, tiles = [], [], [], []
            for shingles in shingle_sets(part.column(1), n):
                name = _class(shingles)
                new = len(shingles) > 0 and name not in seen
                if len(seen) > 1_000_000:
                    seen.clear()  # a repeated sketch changes nothing
                seen.add(name)
                sizes.append(len(shingles))
                classes.append(name)
                bitmaps.append(_bitmap(shingles) if new else None)
                tiles.append(_tiles(shingles, bands).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(bitmaps, pa.list_(pa.int64())), pa.array(tiles, pa.list_(pa.int64()))],
                names=["key", "size", "class", "bitmap", "tiles"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(batches), f"key {rows.schema['key'].dataType.simpleString()}, size long, class long, bitmap array<long>, tiles array<long>")


_WORDS = [f"w{i}" for i in range(BITS // 64)]


def _bound(share: tuple[int, int]) -> Column:
    """Whether sizes, and then bitmaps, of the sides l and r allow a link: each bit that one has and the other lacks is a
    member that is not shared. Over plain columns, so a join checks it in generated code before it makes a row."""
    left, right = F.col("l.size"), F.col("r.size")
    sizes = (left * share[1] >= right * share[0]) & (right * share[1] >= left * share[0])
    extra = [
        reduce(add, [F.bit_count(F.col(f"{x}.{w}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{w}")))) for w in _WORDS])
        for x, y in (("l", "r"), ("r", "l"))
    ]
    most = F.least(left - extra[0], right - extra[1])
    return sizes & (most * share[1] >= (left + right - most) * share[0])


def _verified(pairs: DataFrame, cards: DataFrame, docs: DataFrame, key: str, text: str, n: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b of classes) whose sets reach the bound: bitmap counts first, then sorted arrays."""
    card = cards.select("class", "size", *_WORDS)
    near = cut_lineage(
        pairs.join(card.alias("l"), F.col("a") == F.col("l.class")).join(card.alias("r"), F.col("b") == F.col("r.class"))
        .where(_bound(share)).select("a", "b")
    )
    needed = near.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(cards.select("class", "holder"), "class").select("class", "holder")
    holders = cut_lineage(needed)
    few = holders.count() <= BROADCAST_ROWS
    found = docs.select(F.col(key).alias("holder"), F.col(text).cast("string").alias("text"))
    chosen = found.join(F.broadcast(holders) if few else holders, found["holder"].eqNullSafe(holders["holder"]), "inner").select("class", "text")

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names, sets, held = [], [], 0
            for name, shingles in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), n)):
                if _class(shingles) == name:
                    names.append(name)
                    sets.append(shingles.view(np.int64))
                    held += len(shingles)
                if held > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["class", "shingles"])
                    names, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["class", "shingles"])

    sets = chosen.mapInArrow(lean(exact), "class long, shingles array<long>")
    one, other = sets.toDF("a", "left"), sets.toDF("b", "right")

    def linked(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            left, right = part.column(2), part.column(3)
            for i in range(len(part)):
                x, y = (np.asarray(side[i].values).view(np.uint64) for side in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * share[1] >= (len(x) + len(y) - common) * share[0])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.join(one, "a").join(other, "b").select("a", "b", "left", "right").mapInArrow(lean(linked), "a long, b long")


def link_classes(docs: DataFrame, key: str, text: str, n: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(key, size, class) of each row, and (class, root) of each class that is linked to another one."""
    bands = Bands(share)
    sketch = cut_lineage(sketches(docs, key, text, n, bands))
    one = sketch.where("bitmap IS NOT NULL").groupBy("class").agg(F.min("size").alias("size"), F.min("bitmap").alias("bitmap"), F.min("key").alias("holder"))
    cards = cut_lineage(one.select("class", "size", "holder", *[F.get("bitmap", F.lit(i)).alias(w) for i, w in enumerate(_WORDS)]))
    # Dealt by tile once: the grouping and the join on the tile both find it so.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sketch.where("tiles IS NOT NULL").select(F.explode("tiles").alias("tile"), "class").repartition(parts, "tile")
    shared = dealt.groupBy("tile").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("tile", "least")
    members = cut_lineage(dealt.join(shared, "tile").distinct())

    first = members.where("class <> least").groupBy(F.col("least").alias("a"), F.col("class").alias("b")).count()
    links = cut_lineage(_verified(first.select("a", "b"), cards, docs, key, text, n, share))
    roots = cut_lineage(components(links))

    def rooted(column: str, name: str) -> DataFrame:
        return roots.select(F.col("node").alias(column), F.col("root").alias(name))

    placed = (
        members.join(rooted("class", "root"), "class", "left").join(rooted("least", "least_root"), "least", "left")
        .select("tile", "class", F.coalesce("root", "class").alias("root"), F.coalesce("least_root", "least").alias("least_root"), (F.col("class") == F.col("least")).alias("is_least"))
    )
    # A stray has another component than its tile's smallest member, which it has been compared with.
    split = placed.where("root <> least_root").select("tile").distinct()
    mixed = placed.where("NOT is_least").join(split, "tile", "left_semi").select("tile", "class", "root", (F.col("root") != F.col("least_root")).alias("stray"))
    mixed = cut_lineage(mixed)
    # Near copies meet in many tiles. A pair that meets in one of the first tiles of both its members makes its row in the first such tile only.
    first = F.slice(F.sort_array(F.collect_list(F.struct("tile", "stray"))), 1, HEADS)
    heads = mixed.groupBy("class").agg(first.alias("first")).select("class", F.col("first.tile").alias("any_head"), F.filter("first", lambda x: x["stray"])["tile"].alias("stray_head"))
    mixed = cut_lineage(mixed.join(heads, "class").join(cards.drop("holder"), "class"))
    others = (F.col("l.tile") == F.col("r.tile")) & (F.col("l.root") != F.col("r.root")) & (~F.col("r.stray") | (F.col("l.class") < F.col("r.class")))
    meets = F.array_union(F.array_intersect("l.stray_head", "r.any_head"), F.array_intersect("l.any_head", "r.stray_head"))
    once = F.coalesce(F.array_min(meets), F.col("l.tile")) >= F.col("l.tile")
    rest = (
        mixed.where("stray").alias("l").join(mixed.alias("r"), others & _bound(share) & once)
        .select(F.least("l.class", "r.class").alias("a"), F.greatest("l.class", "r.class").alias("b")).distinct()
    )
    more = cut_lineage(_verified(rest, cards, docs, key, text, n, share))
    return sketch.select("key", "size", "class"), components(links.union(more))


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """(key, n_shingles, component_id) for each row: its set's size, and the smallest key that links reach from it.

    Rows are linked when overlap / union of their shingle sets is at least share[0] / share[1]. Equal sets are one class. Null texts and
    texts without words have 0 shingles and are linked with nothing: their component is their own key. Repeated rows keep their rows; a null key
    is never the smallest while another one is reachable. Other columns are not read. Sets are compared by 64-bit hashes of their shingles.
    """
    rows, roots = link_classes(docs, key, text, n, share)
    rooted = rows.where("size > 0").join(roots, F.col("class") == F.col("node"), "left").select("key", "size", F.coalesce("root", "class").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("key").alias("component_id"))
    full = rooted.join(smallest, "root").select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")
    return full.union(rows.where("size = 0").select("key", F.lit(0).cast("long"), "key"))
