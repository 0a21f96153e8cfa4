"""Exact top-k search by inner product in integers: length buckets with coordinate and length pruning.

Rows are laid out by falling length and cut into buckets, each a matrix of bounded size. A query's score is compared with theta, a score that at least k
rows reach: the k-th best of the query over the longest bucket. In a bucket with longest row l the cosine of a pair must reach the local threshold
theta / (|q| l). Above 1, the bucket is not visited. Else a query takes the cheaper of two prunings: by length, the prefix
of the bucket with |p| >= theta / |q|; or by coordinate, the rows whose normalised coordinates lie where that cosine allows them, for the coordinates in which the query is
largest. What is left is multiplied out exactly in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialweave.operators.relational import unsent
from trialweave.session import cut_lineage

#: Components of a bucket's and of a query block's matrix, rows of the longest bucket that give theta, and coordinates that are looked at.
BUCKET_CELLS, BLOCK_CELLS, FOCUS = 1 << 18, 1 << 15, 3
#: Bytes of the longest buckets that go to every task.
SEED_BYTES = 32 << 20
#: A query is looked up by coordinate where that leaves at most this share of the rows that length leaves.
COORDINATE_SHARE = 1 / 8
#: Below this squared length, products of float64 matrices are exact.
_EXACT = 1 << 53


def integers(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """(id, v, n, squared) with v = floor(scale * x), for rows with an id and a vector without null or not finite components."""
    v = F.col(vector).cast("array<double>")
    out = vectors.select(F.col(key).cast("long").alias("id"), v.alias("x")).where("id IS NOT NULL AND x IS NOT NULL")
    out = out.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    out = out.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    # The square sum is exact or an error; scores are never larger than the largest of them.
    return out.select("id", "v", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("squared"))


def _packed(rows: DataFrame, cells: int) -> DataFrame:
    """(n, longest, ids, matrix): rows by falling length, cut into blocks of at most `cells` components and one dimension each; the rows stay on their tasks."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, squared, ids = (part.column(i).to_numpy() for i in (0, 1, 2))
            values = part.column(3).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
            edges = np.concatenate([[0], np.flatnonzero(np.diff(n)) + 1, [len(n)]])
            out = []
            for low, high in zip(edges, edges[1:]):
                step = max(1, cells // max(1, int(n[low]))) if high > low else 1
                for at in range(low, high, step):
                    end = min(at + step, high)
                    out.append((int(n[at]), int(squared[at]), ids[at:end].tobytes(), values[ends[at] : ends[end]].tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, x)) for x in out], schema=_BLOCK)

    return rows.select("n", "squared", "id", "v").mapInArrow(pack, "n int, longest bigint, ids binary, matrix binary")


_BLOCK = pa.schema([("n", pa.int32()), ("longest", pa.int64()), ("ids", pa.binary()), ("matrix", pa.binary())])


def _unpack(ids: bytes, matrix: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    of = np.frombuffer(ids, np.int64)
    return of, np.frombuffer(matrix, np.int64).reshape(len(of), n)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; through float64 where every partial sum fits its mantissa."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float((a * a).sum(axis=1).max()) * float((b * b).sum(axis=1).max()) < float(_EXACT) ** 2 / 4:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


class Bucket:
    """Rows by falling length with sorted normalised coordinates."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        self.lengths = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
        order = np.argsort(-self.lengths, kind="stable")
        self.ids, self.matrix, self.lengths = ids[order], matrix[order], self.lengths[order]
        self.unit = self.matrix / np.maximum(self.lengths, 1e-300)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self._sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self._sorted[f] = order, self.unit[order, f]
        return self._sorted[f]

    def feasible(self, unit: np.ndarray, cosine: float) -> tuple[np.ndarray | None, int]:
        """Rows that the query's largest coordinates allow at that cosine and how many the best coordinate alone leaves; None where nothing is pruned."""
        if cosine <= 0:
            return None, len(self.ids)
        cosine = min(1.0, cosine) - 1e-9
        best, ranges = (len(self.ids) + 1, -1, 0, 0), []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            centre, spread = unit[f] * cosine, np.sqrt((1 - cosine**2) * max(0.0, 1 - unit[f] ** 2))
            low = -1.0 if unit[f] <= -cosine else centre - spread
            high = 1.0 if unit[f] >= cosine else centre + spread
            low, high = low - 1e-9, high + 1e-9
            values = self.by_coordinate(int(f))[1]
            first, end = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
            ranges.append((int(f), low, high))
            best = min(best, (int(end - first), int(f), int(first), int(end)))
        count, f, first, end = best
        if count > COORDINATE_SHARE * len(self.ids):
            return None, count
        rows = self.by_coordinate(f)[0][first:end]
        for g, low, high in ranges:
            if g != f:
                rows = rows[(self.unit[rows, g] >= low) & (self.unit[rows, g] <= high)]
        return np.sort(rows), count

    def search(self, ids: np.ndarray, queries: np.ndarray, theta: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, score) of the k best rows of each query among those that reach theta (where `known`), ties to the smaller id."""
        lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
        most = self.lengths[0] if len(self.lengths) else 0.0
        need = np.where(known, theta.astype(float) - 1e-6 * np.maximum(1.0, np.abs(theta)), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_length = []
        for q in np.flatnonzero(lengths * most >= need):
            cosine = need[q] / (lengths[q] * most) if lengths[q] * most > 0 else -1.0
            rows, _ = self.feasible(queries[q] / lengths[q], cosine) if cosine > 0 else (None, 0)
            if rows is None:
                by_length.append(q)
                continue
            rows = rows[self.ids[rows] != ids[q]]
            found.append((np.full(len(rows), q), self.ids[rows], products(queries[q : q + 1], self.matrix[rows])[0]))
        if by_length:
            q = np.array(by_length)
            prefix = int(np.max([np.searchsorted(-self.lengths * lengths[x], -need[x], side="right") for x in q]))
            scores = products(queries[q], self.matrix[:prefix])
            own = ids[q][:, None] == self.ids[None, :prefix]
            floor = np.where(known[q], theta[q], np.iinfo(np.int64).min)
            if prefix > k:
                floor = np.maximum(floor, _kth(scores, own, k))
            at, of = np.nonzero((scores >= floor[:, None]) & ~own)
            found.append((q[at], self.ids[of], scores[at, of]))
        query, of, scores = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(3))
        kept = ~known[query] | (scores >= theta[query])
        return _best(query[kept], of[kept], scores[kept], k)


def _kth(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row without the query's own; the least integer where there are fewer."""
    masked = np.where(own, np.iinfo(np.int64).min, scores)
    return np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k] if masked.shape[1] >= k else np.full(len(scores), np.iinfo(np.int64).min)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.concatenate([[True], np.diff(query) != 0])[: len(query)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    kept = np.arange(len(query)) - start < k
    return query[kept], ids[kept], scores[kept]


def _aimed(blocks: DataFrame, buckets: list[tuple[int, int, int]], seeds: dict[int, tuple[bytes, bytes]], k: int) -> DataFrame:
    """The query blocks with theta of each query, and the numbers of the buckets that one of the block's queries must visit."""
    shared = blocks.sparkSession.sparkContext.broadcast((buckets, seeds))

    def aim(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_buckets, known_seeds = shared.value
        of = {}
        for number, n, longest in known_buckets:
            of.setdefault(n, []).append((longest, number))
        lists = {n: (np.sqrt(np.array([x for x, _ in b], float)), np.array([i for _, i in b])) for n, b in of.items()}
        for part in parts:
            out = []
            for row in part.to_pylist():
                n = row["n"]
                ids, queries = _unpack(row["ids"], row["matrix"], n)
                theta, known = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                if n in known_seeds:
                    seed_ids, seed = _unpack(*known_seeds[n], n)
                    theta = _kth(products(queries, seed), ids[:, None] == seed_ids[None, :], k)
                    known = theta > np.iinfo(np.int64).min
                lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
                need = np.where(known, theta.astype(float) - 1e-6 * np.maximum(1.0, np.abs(theta)), -np.inf)
                longest, numbers = lists[n]
                # A bucket is visited if its longest row can reach theta for some query: the least theta / |q| decides.
                least = min((need[i] / lengths[i] if lengths[i] > 0 else -np.inf for i in range(len(ids))), default=np.inf)
                out.append(row | {"theta": theta.tobytes(), "known": known.tobytes(), "buckets": numbers[longest >= least].tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=_AIMED)

    return blocks.select("block", "n", "ids", "matrix").mapInArrow(aim, "block long, n int, ids binary, matrix binary, theta binary, known binary, buckets array<bigint>")


_AIMED = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("theta", pa.binary()), ("known", pa.binary()), ("buckets", pa.list_(pa.int64()))])


def _numbered(packed: DataFrame, name: str) -> DataFrame:
    """Blocks with a number, written: the number does not change when a task runs again."""
    return cut_lineage(packed.withColumn(name, F.monotonically_increasing_id()))


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, bucket_cells: int = BUCKET_CELLS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """(query_id, rank, key, score): for each query row the k rows with the highest integer inner product of floor(scale * x), exactly.

    `is_query` is a condition over `id`. Every row but those with the query's own id is a candidate; ties go to the smaller id; with fewer
    candidates there are fewer rows. Rows without an id, null vectors, and vectors that hold null or not finite components take no part; zero and
    empty vectors do. Vectors of different lengths are searched apart. Equal query rows are one query; candidates that repeat a row stay repeated.
    No queries or no rows: no result. A vector whose squared length leaves 64 bits is an error.

    Each bucket meets each block of queries that may reach it once, so work is bounded by queries times rows in blocks of bounded size, and only the k best of a query
    and bucket are shuffled. Equal lengths are dealt out by a hash of the id, so copies of a vector fill several buckets.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(integers(vectors, key, vector, scale))
    cells = rows.agg(F.sum(F.greatest("n", F.lit(1)).cast("long"))).first()[0] or 0
    schema = f"query_id long, rank int, {key} long, score long"
    if not cells:
        return spark.createDataFrame([], schema)

    def laid_out(some: DataFrame, parts: int) -> DataFrame:
        by = [F.col("n"), F.desc("squared"), F.xxhash64("id")]
        return some.repartitionByRange(max(1, parts), *by).sortWithinPartitions("n", F.desc("squared"), "id")

    buckets = _numbered(_packed(laid_out(rows, -(-cells // (4 * bucket_cells))), bucket_cells), "bucket")
    asked = rows.where(is_query).dropDuplicates(["id", "v"])
    # Queries spread over many small blocks' worth of tasks; a block keeps queries of like length together.
    blocks = _numbered(_packed(laid_out(asked, spark.sparkContext.defaultParallelism), block_cells), "block")

    about = [(r.bucket, r.n, r.longest) for r in buckets.select("bucket", "n", "longest").collect()]
    first: dict[int, tuple[int, int]] = {}
    for number, n, longest in sorted(about):
        if n not in first or longest > first[n][1]:
            first[n] = (number, longest)
    # The longest bucket of each dimension, while they fit; a dimension without one has no theta at first and is searched whole.
    room = [number for number, _ in list(first.values())[: max(1, SEED_BYTES // (16 * bucket_cells))]]
    seeds = {r.n: (bytes(r.ids), bytes(r.matrix)) for r in buckets.where(F.col("bucket").isin(room)).collect()}

    aimed = cut_lineage(_aimed(blocks, about, seeds, k)).withColumn("bucket", F.explode("buckets")).drop("buckets", "n")
    # The planner weighs a block as one however many buckets it goes to, so the blocks are not to be broadcast.
    met = unsent(aimed).join(buckets.select("bucket", "n", F.col("ids").alias("of"), F.col("matrix").alias("rows")), "bucket")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, None
        for part in parts:
            for row in part.to_pylist():
                if last != row["bucket"]:
                    last, bucket = row["bucket"], Bucket(*_unpack(row["of"], row["rows"], row["n"]))
                ids, queries = _unpack(row["ids"], row["matrix"], row["n"])
                q, of, score = bucket.search(ids, queries, np.frombuffer(row["theta"], np.int64), np.frombuffer(row["known"], bool), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["block"])), pa.array(q), pa.array(ids[q]), pa.array(of), pa.array(score)], names=["block", "q", "query_id", "id", "score"])

    found = met.select("bucket", "block", "n", "ids", "matrix", "theta", "known", "of", "rows").mapInArrow(verify, "block long, q long, query_id long, id long, score long")
    best = Window.partitionBy("block", "q").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
