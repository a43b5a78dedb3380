"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

N-grams of three to five UTF-8 bytes are hashed to a fixed number of buckets.
From the training sample come each bucket's counts of toxic and other
documents, and from those its log-count ratio; logistic regression is fitted on
the n-gram rates times their ratios.  The product of both is one weight for
each bucket, so a text's score is the mean weight of its n-grams, read in one
narrow pass without a shuffle.

Training uses at most `train_rows` labelled documents, picked by a hash of
their id class by class, and weighs the `kept_buckets` buckets with the most
evidence.  Labels, language, source and id are no features.

Defined cases: null text is empty; an empty text scores by the intercept
alone; long texts are read whole, in windows; a document labelled twice counts
as toxic if any label says so; with labels of one class only, every score is
that class's share, 0.5 with no labels at all; repeated rows are scored each; null ids are scored,
and no label is theirs; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample
from .linear import Counts, fit_logistic, sigmoid
from .ngrams import byte_ngrams, folded_windows, row_sums
from .textbatch import slices

ORDERS = (3, 4, 5)
BITS = 18
#: Labelled rows that the classifier is fitted on, at most, and n-gram buckets that it weighs.
TRAIN_ROWS, KEPT_BUCKETS = 12_000, 1 << 15


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


def _buckets(text: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of one text."""
    found = [byte_ngrams(part, n, BITS) for n, part, _ in folded_windows(text, np.array([0, len(text)]), ORDERS)]
    return np.concatenate(found)


def _presence(sample: DataFrame) -> np.ndarray:
    """Documents that have each bucket, by class, and in the last column all documents: shape (2, buckets + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), dtype=np.int64)
        for batch in batches:
            label = np.asarray(batch.column(1))
            for first, _, data, offsets in slices(batch.column(0)):
                for k in range(len(offsets) - 1):
                    row = counts[int(label[first + k] > 0)]
                    row[np.unique(_buckets(data[offsets[k] : offsets[k + 1]]))] += 1
                    row[-1] += 1
        at = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "other", "toxic"])

    sums = sample.select("text", F.col("label").cast("long")).mapInArrow(run, "bucket long, other long, toxic long")
    found = sums.groupBy("bucket").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    out = np.zeros((2, (1 << BITS) + 1))
    out[:, found["bucket"].to_numpy()] = found["other"].to_numpy(), found["toxic"].to_numpy()
    return out


def _features(sample: DataFrame, scale: np.ndarray) -> tuple[Counts, np.ndarray]:
    """Counts of the buckets with a scale, as rates times the scale, and the labels; at most TRAIN_ROWS rows.

    The sample's partitions reach the driver one after the other, columns and
    counts in two bytes each; a count beyond them is several entries.
    """
    place = np.cumsum(scale != 0) - 1
    place[scale == 0] = -1
    narrow = "<u2" if np.count_nonzero(scale) <= 1 << 16 else "<u4"
    kept = sample.sparkSession.sparkContext.broadcast(place.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, most = kept.value, (1 << 16) - 1
        for batch in batches:
            out = []
            for _, _, data, offsets in slices(batch.column(0)):
                for k in range(len(offsets) - 1):
                    buckets = _buckets(data[offsets[k] : offsets[k + 1]])
                    found = place[buckets]
                    at, n = np.unique(found[found >= 0], return_counts=True)
                    while len(n) and n.max() > most:
                        more = n > most
                        at, n = np.append(at, at[more]), np.append(np.minimum(n, most), n[more] - most)
                    out.append((at.astype(narrow).tobytes(), n.astype("<u2").tobytes(), max(1, len(buckets))))
            kinds = (pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds))], names=["label", "at", "n", "total"])

    rows = cut(sample.select("text", F.col("label").cast("long")).mapInArrow(run, "label long, at binary, n binary, total long"))
    size = (rows.agg(F.sum(F.length("n"))).first()[0] or 0) // 2
    columns, counts, sizes, totals, labels, end = np.empty(size, dtype=narrow), np.empty(size, dtype="<u2"), [], [], [], 0
    for row in rows.toLocalIterator():
        n = len(row["n"]) // 2
        columns[end : end + n], counts[end : end + n] = np.frombuffer(row["at"], dtype=narrow), np.frombuffer(row["n"], dtype="<u2")
        end += n
        sizes.append(n)
        totals.append(row["total"])
        labels.append(row["label"] > 0)
    matrix = Counts(np.array(sizes, dtype=np.int64), columns, counts, 1 / np.array(totals, dtype=float), scale[scale != 0])
    return matrix, np.array(labels, dtype=float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, l2: float = 1e-3, kept_buckets: int = KEPT_BUCKETS) -> Model:
    """Fit on documents whose id is in `labels` (id_col, label: above 0 is toxic); 1 << BITS buckets are all."""
    once = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max("label") > 0).cast("long").alias("label"))
    sample = labelled_sample(docs, once, train_rows, id_col, text_col)
    counts = _presence(sample)
    n_other, n_toxic = counts[:, -1]
    weights = np.zeros(1 << BITS)
    if not n_other or not n_toxic:
        share = n_toxic / (n_other + n_toxic) if n_other + n_toxic else 0.5
        return Model(weights.astype(np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    present = counts[:, :-1]
    p, q = (present[1] + 1) / (n_toxic + 2), (present[0] + 1) / (n_other + 2)
    ratio = np.log(p / q)
    # Evidence for a difference between the classes: buckets with the most are weighed, the others get no weight.
    pooled = (present.sum(axis=0) + 1) / (n_other + n_toxic + 2)
    evidence = np.abs(p - q) / np.sqrt(pooled * (1 - pooled) * (1 / n_other + 1 / n_toxic))
    # A bucket that no text has would show the classes' sizes only.
    absent = present.sum(axis=0) == 0
    evidence[absent], ratio[absent] = 0, 0
    ratio[np.argsort(-evidence, kind="stable")[kept_buckets:]] = 0
    matrix, y = _features(sample, 100 * ratio)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
    used = np.flatnonzero(ratio)
    w, intercept = fit_logistic(matrix, y, balance, l2 / len(y))
    weights[used] = w * ratio[used] * 100
    return Model(weights.astype(np.float32), intercept)


def scores(column: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    out = np.full(len(column), intercept)
    for first, stop, data, offsets in slices(column, 1 << 18):
        sums, total = np.zeros(stop - first), np.zeros(stop - first)
        for n, part, at in folded_windows(data, offsets, ORDERS):
            sums += row_sums(weights[byte_ngrams(part, n, BITS)], at, n)
            total += np.maximum(np.diff(at) - n + 1, 0)
        out[first:stop] += sums / np.maximum(total, 1)
    return sigmoid(out)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1), *shared.value))], names=["__id", "score"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, score double").withColumnRenamed("__id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), *shared.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
