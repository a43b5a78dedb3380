"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams, of one to four UTF-8 bytes,
that both have (each n-gram counted once, hashed to a fixed number of buckets),
divided by the geometric mean of their own numbers: a blended-spectrum presence
kernel.  Landmark texts of every language span a Nyström space in which
one-versus-rest kernel ridge regression is solved.  A batch of texts is scored
by two matrix products, n-gram presence times landmarks, then kernel values
times coefficients, in one narrow pass.

Fitting uses at most `train_rows` documents with a known language, picked by a
hash of their id language by language, and `landmarks` of them for each, fewer
if the languages are so many that they would exceed `MAX_LANDMARKS`, but one
at least.  More languages than `train_rows` are an error.  Language, source and
id are no features.

Defined cases: null texts and texts without a letter get `und` and score 0;
long texts are read whole, in windows; with no training text everything is
`und`; equal values go to the language first in alphabetical order; repeated
rows are predicted each, null ids too, and no label is theirs; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import labelled_sample
from .ngrams import byte_ngrams, fold, windows
from .textbatch import slices

ORDERS = (1, 2, 3, 4)
BITS = 14
#: Texts that the model is fitted on, at most, landmarks for each language, and landmarks that all languages share.
TRAIN_ROWS, LANDMARKS, MAX_LANDMARKS = 4_000, 16, 4096
_BATCH = 64


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 0 and 1 for each text: which buckets its n-grams fall in."""
    n = len(offsets) - 1
    out = np.zeros((n, 1 << BITS), dtype=np.float32)
    flat = out.reshape(-1)
    for part, at in windows(data, offsets, max(ORDERS) - 1):
        folded = fold(part)
        row = np.repeat(np.arange(n, dtype=np.int64) << BITS, np.diff(at))
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(part))
        for order in ORDERS:
            inside = left[: max(0, len(part) - order + 1)] >= order
            cells = row[: len(inside)] + byte_ngrams(folded, order, BITS)
            flat[cells[inside]] = 1
    return out


def kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Normalised kernel values between rows of presence matrices."""
    sizes = np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(z.sum(axis=1), 1))[None, :]
    return (x @ z.T) / sizes


def _pieces(column: pa.Array, rows: int = _BATCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, stop, data, offsets in slices(column, 1 << 19):
        for a in range(0, stop - first, rows):
            b = min(a + rows, stop - first)
            yield first + a, first + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def fit(docs: DataFrame, languages: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = 1e-3) -> Model:
    """Fit on documents whose id is in `languages` (id_col, label: a language)."""
    once = languages.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("label").alias("label"))
    sample = labelled_sample(docs, once, train_rows, id_col, text_col).where(F.col("text").rlike(r"\p{L}"))
    # No more languages than sampled rows.
    names = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if not names:
        return Model([], np.zeros((0, 1 << BITS), dtype=np.float32), np.zeros((0, 0), dtype=np.float32))
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), "text"))
    each = max(1, min(landmarks, MAX_LANDMARKS // len(names)))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in _pieces(batch.column(2)):
                bits = np.packbits(presence(data, offsets) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, stop - first) for c in (0, 1)), pa.array([b.tobytes() for b in bits], pa.binary())], names=["label", "n", "bits"])

    # The landmarks' n-gram bits, not their texts, go to the driver.
    marks = sample.withColumn("n", order).where(F.col("n") <= each).select("label", "n", "text").mapInArrow(marked, "label string, n int, bits binary").collect()
    bits = np.array([np.frombuffer(r["bits"], dtype=np.uint8) for r in sorted(marks, key=lambda r: (r["label"], r["n"]))])
    z = np.unpackbits(bits, axis=1, count=1 << BITS).astype(np.float32)
    shared = sample.sparkSession.sparkContext.broadcast(z)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in _pieces(batch.column(0)):
                values = kernel(presence(data, offsets), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, stop - first), pa.array([v.astype("<f4").tobytes() for v in values], pa.binary())], names=["label", "kernel"]
                )

    found = sample.select("text", "label").mapInArrow(run, "label string, kernel binary").collect()
    k = np.array([np.frombuffer(r["kernel"], dtype="<f4") for r in found], dtype=float)
    y = np.where(np.array([r["label"] for r in found])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    values, vectors = np.linalg.eigh(kernel(z, z).astype(float))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    w = np.linalg.solve(phi.T @ phi + ridge * len(k) * np.eye(phi.shape[1]), phi.T @ y)
    return Model(names, z, np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"])
        for batch in batches:
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            letter = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), dtype=bool)
            if m.languages:
                for first, stop, data, offsets in _pieces(batch.column(1)):
                    values = kernel(presence(data, offsets), m.landmarks) @ m.coefficients[:-1] + m.coefficients[-1]
                    p = np.clip((values + 1) / 2, 1e-6, 1)
                    best[first:stop] = p.argmax(axis=1)
                    score[first:stop] = p.max(axis=1) / p.sum(axis=1)
                best[~letter], score[~letter] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["__id", "lang_pred", "score"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, lang_pred string, score double").withColumnRenamed("__id", id_col)
