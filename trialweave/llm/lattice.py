"""SentencePiece encoding and decoding with a relational lattice.

Words (runs between the cuts that no piece crosses) are solved in tables: their substrings of bounded length are exploded and
equi-joined to the piece table, the longest piece at each position is kept (the others there are its prefixes, which are known with it), positions are grouped by
buckets of words, and a fold over the positions of all words of a bucket finds the best paths. Each distinct word is solved once, however often it occurs.

Solved words go back to the documents in two ways. Frequent words (chosen from a bounded sample of documents; the choice moves
work and never changes a result) are a table of bounded size that every task has. The others are rare by choice, so they travel by shuffle, a block of documents
at a time: a block sends each of its rare words once, to the bucket of the word, and a bucket answers each block with the pieces of its words in the order in
which the block sent them. So neither names of documents nor words travel back. Documents cross the network as word numbers, not as text. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import words
from trialweave.llm.pieces import SPACE, STEPS, PieceTable
from trialweave.llm.workers import give_back, lean
from trialweave.session import cut_lineage

#: Words that every task has, and documents whose words they are chosen from.
FREQUENT, SAMPLE_DOCUMENTS = 300_000, 20_000
#: Buckets of words for each partition: of words that are dealt by themselves, and of those that blocks of documents send.
BUCKETS, SENT = 64, 8
#: Rows and bytes of text from which a block is full.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20


# An edge is one number: its score in steps, then its length, then its piece. Of equal scores the longer edge is larger.
_ID_BITS, _LENGTH_BITS = 21, 6
_LOW = _ID_BITS + _LENGTH_BITS
_UNKNOWN = (1 << _ID_BITS) - 1
#: Positions of a word that are one row on their way to the fold.
SEGMENT = 8


def _weight(score: float, length: int, piece: int) -> int:
    return (round(score * STEPS) << _LOW) + (length << _ID_BITS) + piece


def piece_frame(spark: SparkSession, table: PieceTable) -> DataFrame:
    """(piece, weight, hash): the pieces as edges, and the hash that substrings are looked up by."""
    if table.longest >= 1 << _LENGTH_BITS or max(i for i, _ in table.pieces.values()) >= _UNKNOWN:
        raise ValueError("pieces of up to 63 characters with ids below 2097151 can be encoded")
    rows = spark.createDataFrame([(p, _weight(s, len(p), i)) for p, (i, s) in table.pieces.items()], "piece string, weight long")
    return rows.withColumn("hash", F.xxhash64("piece"))


def by_bucket(found: DataFrame) -> DataFrame:
    """(bucket, word) of a frame (word), dealt by bucket. Buckets follow the number of partitions, and each is folded as a whole."""
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return found.select(F.pmod(F.xxhash64("word"), F.lit(parts * BUCKETS)).cast("int").alias("bucket"), "word").repartition(parts, "bucket")


def solve(distinct: DataFrame, pieces: DataFrame, table: PieceTable) -> DataFrame:
    """(word, ids) of the distinct, not null and not empty words of a frame (bucket, word); ids as `_packed` gives them.

    With a column `places` (block, at) of the words the answers of blocks come instead: (block, bucket, own), own being the ids of the bucket's words of the block, by `at`, as `_closed` gives them.

    Edges are the substrings that are pieces, and single characters that are none, which stand for their byte pieces. A row for each `SEGMENT` positions has the longest piece
    from each of them, so few rows reach Python; the fold keeps the best edge into each position of each word, with the score of the whole path to it. A frame that is dealt
    by bucket needs no shuffle here.
    """
    told = ["places"] * ("places" in distinct.columns)
    found = distinct.select("bucket", "word", *told, F.monotonically_increasing_id().alias("number"))
    found = found.select("*", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    # The first segment of a word alone brings the word along.
    first = [F.when(F.col("start") < SEGMENT, F.col(c)).alias(c) for c in ("word", *told)]
    rest = F.substring("word", F.col("start") + 1, F.lit(table.longest))
    found = found.select("bucket", "number", "start", *first, rest.alias("rest"))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("size"))
    spelled = found.withColumn("part", F.substring("rest", F.lit(1), F.col("size")))
    met = spelled.withColumn("hashed", F.xxhash64("part")).join(F.broadcast(pieces), F.col("hashed") == F.col("hash"), "left")
    edge = F.when(F.col("part") == F.col("piece"), F.col("weight").bitwiseAND((1 << _LOW) - 1)).cast("int")
    edges = met.withColumn("edge", edge).where("edge IS NOT NULL OR size = 1").withColumn("at", F.col("start") % SEGMENT)
    longest = [F.max(F.when(F.col("at") == k, F.col("edge"))).alias(f"at{k}") for k in range(SEGMENT)]
    segments = edges.groupBy("bucket", "number", F.expr(f"start div {SEGMENT}").cast("int").alias("segment"), "word", *told).agg(*longest)
    columns = ["bucket", "number", "segment", "word", *told, F.array(*[F.coalesce(f"at{k}", F.lit(0)) for k in range(SEGMENT)]).alias("longest")]
    shared, byte_ids, width = found.sparkSession.sparkContext.broadcast(_prefixes(table)), table.bytes, _width(table)

    def fold(segments: pa.Table) -> pa.Table:
        texts, ids, sizes, places = _best_paths(segments, shared.value, byte_ids)
        if not told:
            return pa.table({"word": texts, "ids": _packed(ids, sizes)})
        return _answers(segments["bucket"][0].as_py(), ids, sizes, places, width)

    return segments.select(*columns).groupBy("bucket").applyInArrow(fold, "block long, bucket int, own binary" if told else "word string, ids binary")


def _prefixes(table: PieceTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, first weight and number of weights by id): the edges from a position whose longest piece has the id. Behind the ids of pieces come those of a position without one."""
    unknown = _weight(table.unknown_score, 1, _UNKNOWN)
    size = max(i for i, _ in table.pieces.values()) + 2
    edges: list[list[int]] = [[]] * (size - 1) + [[unknown]]
    for piece, (i, _) in table.pieces.items():
        found = [(piece[:n], table.pieces.get(piece[:n])) for n in range(1, len(piece) + 1)]
        edges[i] = [_weight(x[1], len(p), x[0]) for p, x in found if x] + [unknown] * (found[0][1] is None)
    counts = np.array(list(map(len, edges)))
    return np.array([w for one in edges for w in one], np.int64), np.cumsum(counts) - counts, counts


def _best_paths(segments: pa.Table, prefixes: tuple[np.ndarray, np.ndarray, np.ndarray], byte_ids: list[int]) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray, pa.ListArray | None]:
    """(words, their ids in a row, numbers of ids, places) of a bucket: all words advance by one position at a time, over the edges that end there."""
    word = np.unique(segments["number"].to_numpy(), return_inverse=True)[1]
    heads = np.flatnonzero(segments["segment"].to_numpy() == 0)
    heads = pa.array(heads[np.argsort(word[heads])])
    texts = segments["word"].take(heads)
    places = segments["places"].combine_chunks().take(heads) if "places" in segments.column_names else None
    lengths = pc.utf8_length(texts).to_numpy().astype(np.int64)
    longest = segments["longest"].combine_chunks().flatten().to_numpy()
    start = (segments["segment"].to_numpy().astype(np.int64)[:, None] * SEGMENT + np.arange(SEGMENT)).ravel()
    word = np.repeat(word, SEGMENT)
    inside = start < lengths[word]
    longest, start, word = longest[inside], start[inside], word[inside]
    flat, firsts, counts = prefixes
    piece = np.where(longest > 0, longest & _UNKNOWN, len(counts) - 1)
    many = counts[piece]
    weights = flat[np.repeat(firsts[piece] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    word, ends = np.repeat(word, many), np.repeat(start, many) + _steps(weights)
    base = np.cumsum(lengths + 1) - (lengths + 1)
    best = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
    order = np.argsort(ends * len(lengths) + word, kind="stable")
    at, into, weights = ends[order], base[word[order]] + ends[order], weights[order]
    come = into - _steps(weights)
    new = np.flatnonzero(np.diff(into, prepend=-1))
    cuts = np.searchsorted(at[new], np.arange(1, lengths.max() + 2))
    bounds = np.append(new, len(at))
    for low, high in zip(cuts[:-1], cuts[1:]):
        first, last = bounds[low], bounds[high]
        scores = (best[come[first:last]] & -(1 << _LOW)) + weights[first:last]
        best[into[new[low:high]]] = np.maximum.reduceat(scores, new[low:high] - first)
    open_words, place, found = np.arange(len(lengths)), lengths.copy(), []
    while len(open_words):
        edge = best[base[open_words] + place]
        place = place - _steps(edge)
        found.append((open_words, place, edge))
        open_words, place = open_words[place > 0], place[place > 0]
    owner, place, edge = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((place, owner))
    owner, place, ids = owner[order], place[order], edge[order] & _UNKNOWN
    counts = np.ones(len(ids), np.int64)
    unknown = np.flatnonzero(ids == _UNKNOWN)
    if len(unknown):
        spelled = [texts[int(owner[k])].as_py()[int(place[k])].encode() for k in unknown]
        counts[unknown] = list(map(len, spelled))
        many = np.repeat(ids == _UNKNOWN, counts)
        ids = np.repeat(ids, counts)
        ids[many] = [byte_ids[x] for one in spelled for x in one]
    return texts, ids, np.bincount(np.repeat(owner, counts), minlength=len(lengths)), places


def _answers(bucket: int, ids: np.ndarray, sizes: np.ndarray, places: pa.ListArray, width: int) -> pa.Table:
    """(block, bucket, own): what each block gets from a bucket."""
    block, at = (places.flatten().field(i).to_numpy() for i in (0, 1))
    word = np.repeat(np.arange(len(sizes)), pc.list_value_length(places).to_numpy())
    order = np.lexsort((at, block))
    block, word = block[order], word[order]
    new = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
    mine = sizes[word]
    begins = (np.cumsum(sizes) - sizes)[word]
    starts = np.cumsum(mine) - mine
    own = _closed(ids[np.repeat(begins - starts, mine) + np.arange(mine.sum())], mine, width)
    offsets = np.append(starts[new], mine.sum()) * width
    values = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())])
    return pa.table({"block": block[new], "bucket": pa.array(np.full(len(new), bucket, np.int32)), "own": values})


def _steps(edge: np.ndarray) -> np.ndarray:
    return (edge >> _ID_BITS) & ((1 << _LENGTH_BITS) - 1)


def _packed(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each run of so many ids, three bytes for an id."""
    flat = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    offsets = np.append(0, np.cumsum(3 * sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())])


def _ids(data: np.ndarray) -> np.ndarray:
    """The ids of packed bytes."""
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = data.reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int32)


def _width(table: PieceTable) -> int:
    """Bytes for an id and one bit more."""
    return 2 if max(*(i for i, _ in table.pieces.values()), *table.bytes) < 1 << 15 else 3


def _closed(ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The bytes of the ids of words one after the other; the top bit is set in the last id of a word."""
    flat = ids.astype("<u4")
    flat[np.cumsum(sizes) - 1] |= np.uint32(1 << (8 * width - 1))
    return np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4)[:, :width]).ravel()


def _own(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word) of bytes that `_closed` has given."""
    flat = np.zeros((len(data) // width, 4), np.uint8)
    flat[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    ids = flat.view("<u4").ravel()
    last = np.uint32(1 << (8 * width - 1))
    ends = np.flatnonzero(ids & last) + 1
    return (ids & (last - np.uint32(1))).astype(np.int32), np.diff(ends, prepend=0)


#: Rows whose texts are copied at once.
_ROWS = 256


def _split(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What `_split_rows` gives, some rows at a time, so that a task copies little of a batch."""
    for at in range(0, len(column), _ROWS):
        for low, high, *found in _split_rows(column.slice(at, _ROWS)):
            yield at + low, at + high, *found


def _split_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends, rows, hashes) of the pre-tokens of slices of texts, as `pre_tokens` cuts them.

    Each text that is not empty gets a space in front, and U+2581 counts as a space. A pre-token starts at a line break, at
    the first of a run of spaces, and behind a line break.
    """
    texts = pc.replace_substring(pc.fill_null(column, ""), SPACE, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    data, offsets = words.buffers(texts)
    for low, high in words.slices(offsets):
        part = offsets[low : high + 1] - offsets[low]
        text = data[offsets[low] : offsets[high]]
        space, line = text == 0x20, text == 0x0A
        first = np.zeros(len(text) + 1, bool)
        first[part] = True
        start = line | first[:-1]
        start[1:] |= (space[1:] & ~space[:-1]) | (~space[1:] & line[:-1])
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(text)) if len(starts) else starts
        rows = np.repeat(np.arange(high - low), np.diff(np.searchsorted(starts, part)))
        yield low, high, text, starts, ends, rows, words.hashes(text, starts, ends, fold=False)


_SPACE = SPACE.encode()


def _text(data: np.ndarray, start: int, end: int) -> str:
    return data[start:end].tobytes().decode().replace(" ", SPACE)


def frequent_words(docs: DataFrame, text: str, pieces: DataFrame, table: PieceTable) -> pa.Table:
    """(word, ids) of the most frequent words of a bounded sample, most frequent first: at most `FREQUENT`, so their size on the
    driver (as Arrow columns) and in tasks is bounded."""
    spark = docs.sparkSession
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(text).cast("string"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, _, data, starts, ends, _, hashed in _split(part.column(0)):
                _, first, n = np.unique(hashed, return_index=True, return_counts=True)
                found = [_text(data, s, e) for s, e in zip(starts[first], ends[first])]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n)], names=["word", "n"])

    counted = sample.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = cut_lineage(counted.orderBy(F.desc("n"), "word").limit(FREQUENT))
    solved = solve(by_bucket(chosen.select("word")), pieces, table).join(chosen, "word").select("word", "ids", "n").toArrow()
    return solved.sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"])


class _Coder:
    """Frequent words as numbers, small ones for the most frequent, with their pieces in one flat array."""

    def __init__(self, solved: pa.Table) -> None:
        data, offsets = words.buffers(pc.replace_substring(solved["word"], SPACE, " "))
        hashed = words.hashes(data, offsets[:-1], offsets[1:], fold=False) if len(solved) else np.zeros(0, np.uint64)
        order = np.argsort(hashed)
        self.hashes, self.numbers = hashed[order], order
        ids = solved["ids"].combine_chunks()
        self.sizes = pc.binary_length(ids).to_numpy().astype(np.int64) // 3
        begin = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset] if len(ids) else 0
        data = ids.buffers()[2] if len(ids) else b""
        self.flat = _ids(np.frombuffer(data, np.uint8)[begin : begin + 3 * self.sizes.sum()])
        self.begins = np.cumsum(self.sizes) - self.sizes

    def codes(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each pre-token, or the count of frequent words for any other."""
        size = len(self.hashes)
        if not size:
            return np.zeros(len(hashed), np.int64)
        near = np.minimum(np.searchsorted(self.hashes, hashed), size - 1)
        return np.where(self.hashes[near] == hashed, self.numbers[near], size)

    def blocks(self, part: pa.RecordBatch, buckets: int, spelled: bool = False) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """(name, first row, end row, codes of all pre-tokens, their numbers by row, buckets of the own words, own words if wanted) of blocks of rows (key, text, row ...).

        Own words are those that are not frequent, each once, by bucket and then by hash; the code of a pre-token that is one is the count of frequent words plus the word's
        place among them. A block is named by the hashes of its rows in their order, so equal names have equal rows.
        """
        begin, held, parts = 0, 0, []
        for low, high, data, starts, ends, at, hashed in _split(part.column(1)):
            codes = self.codes(hashed)
            rare = np.flatnonzero(codes == len(self.hashes))
            own, first = np.unique(hashed[rare], return_index=True)
            found = [data[s:e].tobytes() for s, e in zip(starts[rare[first]], ends[rare[first]])] if spelled else []
            parts.append((codes, hashed[rare], own, np.bincount(at, minlength=high - low), found))
            held += len(data)
            if high == len(part) or high - begin >= BLOCK_ROWS or held >= BLOCK_BYTES:
                codes, hashed, own, sizes = (np.concatenate([p[k] for p in parts]) for k in range(4))
                own, first = np.unique(own, return_index=True)
                bucket = (own % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(own), np.int64)
                place[order] = np.arange(len(own))
                codes[codes == len(self.hashes)] += place[np.searchsorted(own, hashed)]
                texts = [x for p in parts for x in p[4]]
                named = part.column(2).slice(begin, high - begin).to_numpy().view(np.uint64) + words.mix(np.arange(1, high - begin + 1, dtype=np.uint64))
                name = words.mix(words.mix(named).sum(dtype=np.uint64, keepdims=True)).view(np.int64)
                yield int(name[0]), begin, high, codes, sizes, bucket[order], [texts[i] for i in first[order]] if spelled else []
                begin, held, parts = high, 0, []


def encode(docs: DataFrame, table: PieceTable, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids) for each row: the pieces of the text's best segmentation. Null texts have null ids, empty ones none.

    With `decoded` two columns follow: digest, xxhash64 of the text, and decoded, what the ids spell (see decode; by the same task, so that an executor
    has one Python worker for both). Repeated rows and null keys keep their rows; only the two columns are read. The rows are read twice and must come in the same order
    both times, as those of files do; rows that a shuffle made are written first, and a block that is not found again is an error.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = cut_lineage(rows)
    names = spark.sparkContext.broadcast(_names(table)) if decoded else None
    pieces, width = piece_frame(spark, table), _width(table)
    shared = spark.sparkContext.broadcast(_Coder(frequent_words(rows, "text", pieces, table)))
    rows = rows.select("key", "text", F.xxhash64("key", "text").alias("row"), F.xxhash64("text").alias("digest"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = parts * SENT

    def rare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, _, _, _, _, bucket, found in shared.value.blocks(part, buckets, spelled=True):
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                # Words have no space of their own, and no byte 255.
                sent = [b"\xff".join(found[i:j]).replace(b" ", _SPACE).replace(b"\xff", b" ") for i, j in zip(cuts, [*cuts[1:], len(found)])]
                columns = [pa.array(np.full(len(cuts), name)), pa.array(bucket[cuts], pa.int32()), pa.array(sent, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "words"])

    sent = rows.mapInArrow(lean(rare), "block long, bucket int, words string").repartition(parts, "bucket")
    wanted = sent.select("block", "bucket", F.posexplode(F.split("words", " ")).alias("at", "word"))
    distinct = wanted.groupBy("bucket", "word").agg(F.collect_set(F.struct("block", "at")).alias("places"))
    found = solve(distinct, pieces, table)
    give_back()  # the driver keeps none of what the tables of words and pieces were made with
    answers = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "own")))["own"].alias("own"))

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            valid = part.column(1).is_valid().to_numpy(zero_copy_only=False)
            for name, low, high, codes, sizes, bucket, _ in shared.value.blocks(part, buckets):
                row = [pa.array([0, high - low], pa.int32())]
                sizes = pa.array(sizes, pa.int32(), mask=~valid[low:high])
                lists = [pa.ListArray.from_arrays(*row, x) for x in (part.column(0).slice(low, high - low), part.column(3).slice(low, high - low), sizes)]
                body = pa.array([_pack(codes.astype(np.uint32))], pa.binary())
                columns = [pa.array([name]), *lists, body, pa.array([len(bucket)], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "keys", "digests", "sizes", "body", "n_own"])

    kind = rows.schema["key"].dataType.simpleString()
    bodies = rows.mapInArrow(lean(coded), f"block long, keys array<{kind}>, digests array<long>, sizes array<int>, body binary, n_own int")

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for part in parts:
            for i in range(len(part)):
                keys, digests, sizes = (part.column(c)[i].values for c in range(3))
                own, own_sizes = _own(b"".join(part.column(5)[i].as_py() or []), width)
                if len(own_sizes) != part.column(4)[i].as_py():
                    raise ValueError("the documents came in another order when they were read again")
                codes = _unpack(part.column(3)[i].as_py())
                ends = np.append(0, np.cumsum(pc.fill_null(sizes, 0).to_numpy()))
                for low in range(0, len(keys), _ROWS):
                    high = min(low + _ROWS, len(keys))
                    ids, counts = _spell(codes[ends[low] : ends[high]], coder, own, own_sizes)
                    offsets = np.append(0, np.cumsum(counts))[ends[low : high + 1] - ends[low]]
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids), mask=sizes.slice(low, high - low).is_null())
                    columns = [keys.slice(low, high - low), ids]
                    if decoded:
                        columns += [digests.slice(low, high - low), _texts(ids, names.value)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "digest", "decoded"][: len(columns)])

    together = bodies.join(answers, "block", "left").select("keys", "digests", "sizes", "body", "n_own", "own")
    return together.mapInArrow(lean(joined), f"key {kind}, ids array<int>" + ", digest long, decoded string" * decoded).withColumnRenamed("key", key)


def _pack(codes: np.ndarray) -> bytes:
    """Two bytes for numbers below 65,535, six for others; low bytes, high bytes, and the four bytes of the others, compressed."""
    large = codes >= 0xFFFF
    planes = np.where(large, 0xFFFF, codes).astype("<u2").view(np.uint8).reshape(-1, 2).T
    plain = planes.tobytes() + codes[large].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.array([len(codes), len(plain)], np.uint32).tobytes() + pa.Codec("zstd", 1).compress(plain, asbytes=True)


def _unpack(body: bytes) -> np.ndarray:
    n, size = map(int, np.frombuffer(body, np.uint32, 2))
    plain = pa.Codec("zstd").decompress(body[8:], size, asbytes=True) if size else b""
    low, high = np.frombuffer(plain, np.uint8, 2 * n).reshape(2, n).astype(np.uint32)
    codes = low + (high << 8)
    others = np.frombuffer(plain[2 * n :], np.uint8).reshape(4, -1).T
    codes[codes == 0xFFFF] = np.ascontiguousarray(others).view("<u4").ravel()
    return codes


def _spell(codes: np.ndarray, coder: _Coder, own: np.ndarray, own_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of word numbers, and how many each has; numbers from the count of frequent words on are the block's own words."""
    size = len(coder.sizes)
    codes = codes.astype(np.int64)
    mine = codes >= size
    counts, begins = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
    counts[~mine], begins[~mine] = coder.sizes[codes[~mine]], coder.begins[codes[~mine]]
    counts[mine], begins[mine] = own_sizes[codes[mine] - size], (np.cumsum(own_sizes) - own_sizes)[codes[mine] - size]
    at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out, from_own = np.empty(len(at), np.int32), np.repeat(mine, counts)
    out[from_own], out[~from_own] = own[at[from_own]], coder.flat[at[~from_own]]
    return out, counts


def encode_and_decode(docs: DataFrame, table: PieceTable, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, round_trip): `encode`, and whether the ids of the row decode to its text (compared by 64-bit digests)."""
    both = encode(docs, table, key, text, decoded=True)
    return both.select(key, "ids", (F.xxhash64("decoded") == F.col("digest")).alias("round_trip"))


def _names(table: PieceTable) -> pa.Array:
    """What each id spells, null for an id that is no piece."""
    names = {i: p.replace(SPACE, " ").encode() for p, (i, _) in table.pieces.items()} | {i: bytes([b]) for b, i in enumerate(table.bytes)}
    return pa.array([names.get(i) for i in range(max(names) + 1)], pa.binary())


def _texts(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    flat = ids.flatten()
    spelled = names.take(flat)
    if spelled.null_count:
        raise KeyError(flat.filter(spelled.is_null())[0].as_py())
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    rows = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), spelled, mask=ids.is_null())
    whole = pc.binary_join(rows, b"")
    try:
        return pc.utf8_slice_codeunits(whole.cast(pa.string()), 1)
    except pa.ArrowInvalid:  # byte pieces in an order that is no UTF-8
        return pa.array([None if x is None else x.decode("utf-8", "replace")[1:] for x in whole.to_pylist()], pa.string())


def decode(encoded: DataFrame, table: PieceTable, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) for each row: the pieces joined, byte pieces read as UTF-8, U+2581 as a space, without the space put in front.

    Null ids give a null text. encode and decode give back every text that has no U+2581 of its own (which reads as a space). An id that is no piece fails.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_names(table))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, len(part), 512):
                some = part.slice(low, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), _texts(some.column(1), shared.value)], names=["key", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(batches, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
