"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence of a document: two logistic regressions (quality, toxicity) over text statistics and the presence of the words that
tell the labels apart, fitted on a bounded sample of labelled rows. Evidence of its site: the mean acceptance of the host's documents,
shrunk towards the global mean, and that of the path, shrunk towards the host. How strongly is estimated from the spread between hosts
and between paths, by grouped sums over all documents. The posterior adds the path's log odds (against the global ones) to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trialweave.llm import words
from trialweave.llm.names import fresh
from trialweave.llm.workers import lean
from trialweave.session import cut_lineage

#: Labelled rows that the classifier is fitted on, at most (the smallest hashes of their keys), and telling words kept for each label.
FIT_ROWS, TELLING = 20_000, 128
_BUCKETS = 1 << 18
#: Log odds of a document's own evidence stay within these.
_MOST = 12.0

STATISTICS = (
    "log_words log_bytes upper digit other_mark exclamation bar symbol wide break word_bytes repeated distinct distinct_late".split()
)
_CLASSES = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = (
        1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 else 3 if 48 <= _b <= 57 else 4 if _c == "!" else 5 if _c == "|"
        else 6 if _c in "*#%&$@^~<>={}[]\\_+" else 7 if _b in (10, 13) else 8 if _b in (9, 11, 12, 32) else 9 if _b >= 128 else 0
    )


def statistics(data: np.ndarray, offsets: np.ndarray, hashed: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(rows, statistics) of texts given as bytes and word hashes; all 0 for a text without words."""
    rows = len(offsets) - 1
    row_of_byte = np.repeat(np.arange(rows) << 4, np.diff(offsets))
    n = np.bincount(row_of_byte | _CLASSES[data], minlength=rows << 4).reshape(rows, 16).astype(float)
    count = np.diff(firsts).astype(float)
    row = np.repeat(np.arange(rows), np.diff(firsts))
    repeated = np.bincount(row[1:], (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1]), rows) if len(row) else np.zeros(rows)
    tagged = np.unique((row.astype(np.uint64) << np.uint64(40)) | (hashed >> np.uint64(24)))
    distinct = np.bincount((tagged >> np.uint64(40)).astype(np.int64), minlength=rows).astype(float)
    size, some = np.maximum(1, np.diff(offsets)), np.maximum(1, count)
    letters = np.maximum(1, n[:, 1] + n[:, 2])
    out = np.column_stack([
        np.log1p(count), np.log1p(size), n[:, 1] / letters, n[:, 3] / size, n[:, 0] / some, n[:, 4] / some, n[:, 5] / some, n[:, 6] / some,
        n[:, 9] / size, n[:, 7] / some, (size - n[:, 8]) / some, repeated / some, distinct / some, np.log1p(distinct) / np.log1p(some),
    ])
    out[count == 0] = 0
    return out


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets, hashes of white-space words, their rows' firsts, rows and buckets of the bare words).

    A bare word (letters and digits) counts by itself and by its first four and five bytes, so inflected forms of a rare stem meet."""
    data, offsets = words.buffers(column)
    for low, high in words.slices(offsets):
        part = offsets[low : high + 1] - offsets[low]
        text = data[offsets[low] : offsets[high]]
        starts, ends, firsts = words.spans(text, part, words.WHITE)
        hashed = words.hashes(text, starts, ends)
        starts, ends, bare = words.spans(text, part, words.MARKS)
        forms = words.hashes(text, starts, ends, np.minimum(ends, starts + 4), np.minimum(ends, starts + 5))
        row = np.tile(np.repeat(np.arange(high - low), np.diff(bare)), 3)
        forms[1:] += np.array([[1], [2]], np.uint64) << np.uint64(40)
        yield low, high, text, part, hashed, firsts, row, (words.mix(forms.ravel()) >> np.uint64(20)).astype(np.int64) % _BUCKETS


@dataclass(frozen=True)
class Features:
    """Buckets of the telling words; a document has its statistics and whether each bucket occurs."""

    buckets: tuple[int, ...]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, statistics + buckets), and whether each row has a word."""
        slot = np.full(_BUCKETS, -1, np.int64)
        slot[list(self.buckets)] = np.arange(len(self.buckets))
        parts, worded = [np.zeros((0, len(STATISTICS) + len(self.buckets)))], [np.zeros(0, bool)]
        for low, high, text, offsets, hashed, firsts, row, bucket in _slices(column):
            shown = np.zeros((high - low, len(self.buckets)))
            at = slot[bucket]
            shown[row[at >= 0], at[at >= 0]] = 1
            parts.append(np.hstack([statistics(text, offsets, hashed, firsts), shown]))
            worded.append(np.diff(firsts) > 0)
        return np.vstack(parts), np.concatenate(worded)


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(text, good, toxic) of at most about FIT_ROWS labelled documents; a key with several labels counts as the worst of them."""
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("good"), F.max("toxic").alias("toxic"))
    known = known.where("good IS NOT NULL AND toxic IS NOT NULL")
    share = min(1.0, FIT_ROWS / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_key"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_key")).select("text", "good", "toxic")


def _telling(sample: DataFrame) -> tuple[int, ...]:
    """The buckets whose presence carries most information on a label (log-likelihood ratio), from grouped counts."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good, toxic = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            total = np.zeros((_BUCKETS, 3), np.int64)
            for low, *_, row, bucket in _slices(part.column(0)):
                present = np.unique(row * _BUCKETS + bucket)
                row = low + present // _BUCKETS
                for k, weight in enumerate((np.ones(len(row)), 1 - good[row], toxic[row])):
                    total[:, k] += np.bincount(present % _BUCKETS, weight, _BUCKETS).astype(np.int64)
            held = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(total[held, k]) for k in range(3)]], names=["bucket", "n", "bad", "toxic"])

    counts = sample.mapInArrow(lean(batches), "bucket long, n long, bad long, toxic long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "toxic")])
    counts = cut_lineage(counts.where("n >= 5"))
    n, bad, toxic = sample.agg(F.count("*"), F.sum(1 - F.col("good")), F.sum("toxic")).first()
    chosen = set()
    for label, total in (("bad", bad), ("toxic", toxic)):
        if not n or not total or total == n:
            continue

        def term(observed: Column, expected: Column) -> Column:
            return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

        a, shown = F.col(label), F.col("n")
        gain = sum(
            (term(o, r * c / n) for o, r, c in (
                (a, shown, F.lit(total)), (shown - a, shown, F.lit(n - total)),
                (F.lit(total) - a, F.lit(n) - shown, F.lit(total)), (F.lit(n - total) - (shown - a), F.lit(n) - shown, F.lit(n - total)),
            )), F.lit(0.0),
        )
        chosen |= {r.bucket for r in counts.select("bucket", gain.alias("gain")).where("gain > 10").orderBy(F.desc("gain"), "bucket").limit(TELLING).collect()}
    return tuple(sorted(chosen))


@dataclass(frozen=True)
class Classifier:
    """Log odds of (good, toxic) as intercept and weights over the features."""

    features: Features
    good: tuple[float, ...]
    toxic: tuple[float, ...]

    def odds(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, worded = self.features.of(column)
        return *(np.clip(w[0] + values @ w[1:], -_MOST, _MOST) for w in (np.array(self.good), np.array(self.toxic))), worded


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier:
    """The classifier of labelled documents. A label with one value only gets that value's bounded log odds; no labels: all good."""
    sample = cut_lineage(_labelled(docs, labels, key, text).coalesce(16))
    features = Features(_telling(sample))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values, _ = features.of(part.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(values), pa.list_(pa.float64())), part.column(1), part.column(2)], names=["values", "good", "toxic"])

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    rows = sample.mapInArrow(lean(batches), f"values array<double>, good {kinds['good']}, toxic {kinds['toxic']}")
    rows = cut_lineage(rows.select("values", F.col("good").cast("double").alias("good"), F.col("toxic").cast("double").alias("toxic")))
    vectors = rows.select(array_to_vector("values").alias("values"), "good", "toxic")
    size = len(STATISTICS) + len(features.buckets)
    weights = []
    for label, default in (("good", _MOST), ("toxic", -_MOST)):
        seen = [r[0] for r in rows.select(label).distinct().collect()]
        if len(seen) < 2:
            only = default if not seen else _MOST if seen[0] else -_MOST
            weights.append((only, *[0.0] * size))
        else:
            model = LogisticRegression(featuresCol="values", labelCol=label, regParam=1e-4, maxIter=60).fit(vectors)
            weights.append((float(model.intercept), *map(float, model.coefficients.toArray())))
    return Classifier(features, *weights)


def _scored(docs: DataFrame, text: str, classifier: Classifier, good_name: str, toxic_name: str) -> DataFrame:
    """The rows with log odds in two more columns, null for texts without a word."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    out = T.StructType([*docs.schema.fields, T.StructField(good_name, T.DoubleType()), T.StructField(toxic_name, T.DoubleType())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            good, toxic, worded = shared.value.odds(part.column(part.schema.get_field_index(text)))
            extra = [pa.array(x, pa.float64(), mask=~worded) for x in (good, toxic)]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, good_name, toxic_name])

    return docs.mapInArrow(lean(batches), out)


def _accepts(good: Column, toxic: Column) -> Column:
    """Probability that a document is good and not toxic; null without evidence."""
    return 1 / (1 + F.exp(-good)) * (1 / (1 + F.exp(toxic)))


def _logit(p: Column) -> Column:
    inside = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))  # both skip nulls
    return F.when(p.isNotNull(), F.log(inside / (1 - inside)))


def _strength(groups: DataFrame, mean: str, prior: Column) -> float:
    """Prior rows that a group's mean is shrunk by: mean (1 - mean) / variance between groups, by the method of moments. Without
    spread beyond chance the prior is strong (10^6)."""
    m = F.col(mean)
    row = groups.agg(
        F.sum(F.col("n") * F.pow(m - prior, F.lit(2))).alias("between"), F.sum(F.col("squares") - F.col("n") * m * m).alias("within"),
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.avg(prior * (1 - prior)).alias("scale"),
    ).first()
    if not row.g or row.g < 2 or row.n <= row.g:
        return 1e6
    noise = max(0.0, row.within) / (row.n - row.g)
    spread = max(0.0, (row.between - (row.g - 1) * noise) / (row.n - row.nn / row.n))
    return 1e6 if spread <= 0 else min(1e6, max(1.0, row.scale / spread - 1))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, host_posterior, path_posterior, base) from (host, path, p): shrunk acceptance of each path and its host.

    Null p is no evidence. Sums are grouped by path before the shuffle, and hosts are summed from paths, so a host with a third of all rows costs one row
    for each task. Null hosts and paths are groups like any other.
    """
    paths = cut_lineage(
        scored.groupBy("host", "path").agg(F.count("p").alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("p") * F.col("p")), F.lit(0.0)).alias("squares"))
    )
    hosts = cut_lineage(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "squares")]))
    n, s = hosts.agg(F.sum("n"), F.sum("s")).first()
    base = (s + 0.5) / (n + 1) if n else 0.5
    some = hosts.where("n > 0").withColumn("mean", F.col("s") / F.col("n"))
    k = _strength(some, "mean", F.lit(base))
    shrunk = hosts.select(F.col("host").alias("of"), ((F.col("s") + k * base) / (F.col("n") + k)).alias("host_posterior"))
    joined = cut_lineage(paths.join(shrunk, F.col("host").eqNullSafe(F.col("of"))).drop("of"))
    some = joined.where("n > 0").withColumn("mean", F.col("s") / F.col("n"))
    k = _strength(some, "mean", F.col("host_posterior"))
    return cut_lineage(
        joined.select("host", "path", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"), F.lit(base).alias("base"))
    )


#: Sites that are broadcast; more are joined by a shuffle, whose hot hosts AQE splits.
BROADCAST_SITES = 200_000


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, with p_good, p_toxic, host_posterior, path_posterior, posterior and accepted.

    A document is accepted when its posterior is at least a half and it is more likely not toxic than toxic (a good site does not excuse a toxic text).
    Null texts and texts without a word have no evidence of their own (null p_good and p_toxic): their posterior is their path's. Rows
    that repeat keep their rows. No labels: every document with words is accepted. An empty table gives no rows. Columns of docs with
    the names of the new ones are replaced.
    """
    classifier = fit(docs, labels, key, text)
    new = ["p_good", "p_toxic", "host_posterior", "path_posterior", "posterior", "accepted"]
    kept = docs.select(*[c for c in docs.columns if c not in new])
    at_host, at_path, good, toxic, of_host, of_path, base = fresh(kept, "host", "path", "good", "toxic", "of_host", "of_path", "base")
    placed = _scored(kept.withColumns({at_host: host, at_path: path}), text, classifier, good, toxic)
    bare = docs.select(F.col(text).alias("text"), host.alias("host"), path.alias("path"))
    judged = _scored(bare, "text", classifier, "good", "toxic").select("host", "path", _accepts(F.col("good"), F.col("toxic")).alias("p"))
    sites = site_posteriors(judged).toDF(of_host, of_path, "host_posterior", "path_posterior", base)
    few = sites.count() <= BROADCAST_SITES
    same_site = F.col(at_host).eqNullSafe(F.col(of_host)) & F.col(at_path).eqNullSafe(F.col(of_path))
    joined = placed.join(F.broadcast(sites) if few else sites, same_site)
    own = _accepts(F.col(good), F.col(toxic))
    odds = F.coalesce(_logit(own), _logit(F.col(base))) + _logit(F.col("path_posterior")) - _logit(F.col(base))
    out = joined.withColumns({
        "p_good": 1 / (1 + F.exp(-F.col(good))), "p_toxic": 1 / (1 + F.exp(-F.col(toxic))), "posterior": 1 / (1 + F.exp(-odds)),
    })
    out = out.withColumn("accepted", (F.col("posterior") >= 0.5) & F.coalesce(F.col("p_toxic") < 0.5, F.lit(True)))
    return out.select(*kept.columns, *new)
