"""Quality: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of other characters; each token
and each pair of neighbours is hashed to a bucket, weighed by its rate in the
text.  Training reads the sample row after row with per-coordinate
follow-the-regularised-leader updates, whose first-order penalty keeps most
weights at zero.  A score is a sparse dot product, one narrow pass without a
shuffle.

Training uses at most `train_rows` labelled documents, picked by a hash of
their id class by class.  Labels, language, source and id are no features.

Defined cases: null text is empty; an empty text scores by the intercept
alone; long texts are read whole, a word of any length is one token; a document labelled twice counts as low
quality if any label says so; with labels of one class only, every score is
that class's share, 0.5 with no labels at all; repeated rows are scored each;
null ids are scored, and no label is theirs; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample
from .linear import sigmoid
from .ngrams import word_ngrams
from .textbatch import slices

BITS = 18
#: Labelled rows that the classifier is fitted on, at most.
TRAIN_ROWS = 12_000
#: Rates are this many times a token's share, so that one coordinate's step is of the order of one.
RATE = 16.0


@dataclass
class Model:
    weights: np.ndarray
    intercept: float


class Leader:
    """Per-coordinate follow-the-regularised-leader state for the logistic loss."""

    def __init__(self, n: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: float, weight: float) -> None:
        w = self.weights(at)
        g = weight * (sigmoid(w @ values) - label) * values
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass
class Rows:
    """Label, first entry and number of entries of each sampled row; all rows' buckets and rates."""

    spots: list[tuple[float, int, int]]
    buckets: np.ndarray
    rates: np.ndarray

    def __iter__(self) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for label, first, n in self.spots:
            yield label, self.buckets[first : first + n], self.rates[first : first + n]


def _features(sample: DataFrame) -> Rows:
    """Label, buckets and rates of each sampled row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in slices(batch.column(0)):
                for k in range(len(offsets) - 1):
                    text = data[offsets[k] : offsets[k + 1]]
                    _, buckets = word_ngrams(text, np.array([0, len(text)]), BITS)
                    at, n = np.unique(buckets, return_counts=True)
                    out.append((at.astype("<u4").tobytes(), (RATE * n / max(1, len(buckets))).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["label", "at", "rate"]
            )

    # The sample's partitions reach the driver one after the other, into two buffers; the rows are put into the order of their content.
    rows = cut(sample.select("text", F.col("label").cast("long")).mapInArrow(run, "label long, at binary, rate binary"))
    size = (rows.agg(F.sum(F.length("at"))).first()[0] or 0) // 4
    buckets, rates, found, end = np.empty(size, dtype="<u4"), np.empty(size, dtype="<f4"), [], 0
    for row in rows.toLocalIterator():
        n = len(row["at"]) // 4
        found.append((zlib.crc32(row["at"]), hashlib.sha256(row["at"]).digest(), row["label"], end, n))
        buckets[end : end + n], rates[end : end + n] = np.frombuffer(row["at"], dtype="<u4"), np.frombuffer(row["rate"], dtype="<f4")
        end += n
    spots = [(float(label > 0), first, n) for _, _, label, first, n in sorted(found)]
    return Rows(spots, buckets, rates)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    train_rows: int = TRAIN_ROWS,
    passes: int = 3,
    alpha: float = 0.5,
    l1: float = 0.02,
    l2: float = 0.1,
) -> Model:
    """Fit on documents whose id is in `labels` (id_col, label: above 0 is good)."""
    once = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg((F.min("label") > 0).cast("long").alias("label"))
    rows = _features(labelled_sample(docs, once, train_rows, id_col, text_col))
    size = 1 << BITS
    share = sum(y for y, _, _ in rows.spots) / len(rows.spots) if rows.spots else 0.5
    if share in (0.0, 1.0) or not rows.spots:
        return Model(np.zeros(size, dtype=np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    state = Leader(size + 1, alpha, 1.0, l1, l2)
    one = np.ones(1)
    for _ in range(passes):
        for y, at, rates in rows:
            weight = 0.5 / share if y else 0.5 / (1 - share)
            state.learn(np.append(at, size), np.append(rates, one), y, weight)
    w = state.weights()
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def scores(column: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    """Scores of an Arrow column of texts."""
    out = np.full(len(column), intercept)
    for first, stop, data, offsets in slices(column):
        at, buckets = word_ngrams(data, offsets, BITS)
        n = stop - first
        total = np.bincount(at, minlength=n)
        out[first:stop] += RATE * np.bincount(at, weights[buckets], minlength=n) / np.maximum(total, 1)
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


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), *shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
