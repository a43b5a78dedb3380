"""Vector codes: product quantisation with memoised grid cells, in exact integer arithmetic.

Components become integers, floor(scale * x); vectors are cut into equal parts,
each with a codebook that a few rounds of integer k-means improve.  To find a
part's nearest entry, its coarse grid cell is looked up in a memo.  For a new
cell the entries' least and greatest distances to the cell's box are compared:
an entry whose least distance exceeds another one's greatest is dominated
across the box and can't be nearest to any part in it.  The memo keeps the
others, and only these are evaluated, exactly.  A memo belongs to one task and
holds MEMO_CELLS cells of each part at most, then it starts anew.

Each round is one narrow pass and one aggregation of sums by part, entry and
position; the codebooks (at most `entries` times the vectors' length numbers)
go through the driver.

Defined cases: vectors that are null or hold null or non-finite components are
left out; the most usual length among the others (of equal ones the longest)
is the table's, and vectors of another length, or all if it is no multiple of
the number of parts or zero, have a null code and error; repeated rows are
coded each, a repeated id starts one entry, from its smallest vector; null ids
come last in the order of ids; null labels are one label; components whose
squared distances need more than 62 bits are an error; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Cells of each part that a task's memo holds, and vectors that are worked on at once.
MEMO_CELLS, ROWS = 1 << 15, 4096
#: Cells to the distance between neighbouring entries, over the square root of the dimensions.
CELLS_APART = 4


def scaled(column: pa.Array, length: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors, as integers."""
    values = np.floor(np.asarray(column.flatten(), dtype=np.float64).reshape(-1, length) * scale)
    if values.size and length * (2 * np.abs(values).max()) ** 2 >= 2.0**62:
        raise ValueError("vector components are too large: squared distances need more than 62 bits")
    return values.astype(np.int64)


@dataclass
class Codebook:
    """A part's entries and the width of its grid's cells."""

    entries: np.ndarray
    width: int

    @staticmethod
    def of(entries: np.ndarray) -> Codebook:
        """Cells are small against the distance of an entry to its neighbours, so that few entries are left in one."""
        at = entries.astype(np.float64)
        gaps = (at * at).sum(axis=1)[:, None] - 2 * at @ at.T + (at * at).sum(axis=1)
        gaps[gaps <= 0] = np.inf
        near = gaps.min(axis=1)
        near = near[np.isfinite(near)]
        apart = float(np.sqrt(np.median(near))) if len(near) else 1.0
        return Codebook(entries, max(1, int(apart / (CELLS_APART * np.sqrt(entries.shape[1])))))


class Memo:
    """Entries that aren't dominated across a grid cell, cell by cell."""

    def __init__(self, book: Codebook) -> None:
        self.book, self.cells = book, {}

    def _kept(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries whose least distance to its box is no more than the smallest greatest distance."""
        entries, width = self.book.entries, self.book.width
        low = cells * width
        # The ball around the box sorts out most entries; the slack covers rounding.
        middle, centre = low + (width - 1) / 2, entries.astype(np.float64)
        reach = (width - 1) / 2 * np.sqrt(entries.shape[1])
        far = np.sqrt(np.maximum((middle * middle).sum(axis=1)[:, None] - 2 * middle @ centre.T + (centre * centre).sum(axis=1), 0))
        cell, entry = np.nonzero(far <= (far.min(axis=1, keepdims=True) + 2 * reach) * (1 + 1e-6) + 1)
        below, above = low[cell] - entries[entry], entries[entry] - (low[cell] + width - 1)
        least, most = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
        least, most = (least * least).sum(axis=1), (most * most).sum(axis=1)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        good = least <= np.repeat(np.minimum.reduceat(most, first), np.diff(np.append(first, len(cell))))
        return np.split(entry[good], np.cumsum(np.add.reduceat(good, first))[:-1])

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry (the lowest of the nearest) and squared distance of every row."""
        cells = np.ascontiguousarray(np.floor_divide(rows, self.book.width))
        keys = cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel()
        names, place, back = np.unique(keys, return_index=True, return_inverse=True)
        names = [n.tobytes() for n in names]
        new = [k for k, n in enumerate(names) if n not in self.cells]
        found = {n: self.cells[n] for n in names if n in self.cells}
        if len(self.cells) + len(new) > MEMO_CELLS:
            self.cells = {}
        for at in range(0, len(new), 512):
            some = new[at : at + 512]
            for k, kept in zip(some, self._kept(cells[place[some]])):
                found[names[k]] = self.cells[names[k]] = kept
        lists = [found[n] for n in names]
        sizes = np.array([len(x) for x in lists])
        flat, ends = np.concatenate(lists), np.cumsum(sizes)
        own = sizes[back]
        first = np.cumsum(own) - own
        row = np.repeat(np.arange(len(rows)), own)
        entry = flat[np.arange(own.sum()) - np.repeat(first - (ends - sizes)[back], own)]
        gap = rows[row] - self.book.entries[entry]
        distance = (gap * gap).sum(axis=1)
        least = np.minimum.reduceat(distance, first)
        # Entries of a cell ascend, so the first of the nearest is the lowest.
        hit = np.flatnonzero(distance == least[row])
        return entry[hit[np.searchsorted(row[hit], np.arange(len(rows)))]], least


def _batches(batch: pa.RecordBatch, column: int, length: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, len(batch), ROWS):
        part = batch.slice(at, ROWS)
        yield part, scaled(part.column(column), length, scale)


def _sums(vectors: DataFrame, books: list[Codebook], length: int, scale: int) -> DataFrame:
    """part, entry, pos, total, n: what each entry's parts add up to."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    size = length // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in shared.value]
        totals = [np.zeros(b.entries.shape, dtype=np.int64) for b in shared.value]
        counts = [np.zeros(len(b.entries), dtype=np.int64) for b in shared.value]
        for batch in batches:
            for _, rows in _batches(batch, 0, length, scale):
                for p, memo in enumerate(memos):
                    own = rows[:, p * size : (p + 1) * size]
                    entry, _ = memo.nearest(own)
                    np.add.at(totals[p], entry, own)
                    counts[p] += np.bincount(entry, minlength=len(counts[p]))
        for p, (total, count) in enumerate(zip(totals, counts)):
            used = np.flatnonzero(count)
            n = len(used) * size
            columns = [np.full(n, p), np.repeat(used, size), np.tile(np.arange(size), len(used)), total[used].ravel(), np.repeat(count[used], size)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "pos", "total", "n"])

    rows = vectors.select("vector").mapInArrow(run, "part long, entry long, pos long, total long, n long")
    return rows.groupBy("part", "entry", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """__id, __label, vector of the rows whose vector has finite components only."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).alias("__id"), label.alias("__label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def train(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """Codebooks of rows (__id, vector of `length` components): one integer array (entries, length / parts) for each part."""
    same = vectors.where(F.size("vector") == length)
    # Ids first, so that no other vector is moved; at most `entries` rows are broadcast.
    order = F.col("__id").asc_nulls_last()
    ids = same.select("__id").distinct().orderBy(order).limit(entries).withColumnRenamed("__id", "__first")
    first = same.join(F.broadcast(ids), F.col("__id").eqNullSafe(F.col("__first")), "left_semi").groupBy("__id").agg(F.min("vector").alias("vector"))
    start = scaled(first.orderBy(order).limit(entries).select("vector").toArrow().column(0).combine_chunks(), length, scale)
    size = length // parts
    books = [start[:, p * size : (p + 1) * size].copy() for p in range(parts)]
    for _ in range(rounds):
        for row in _sums(same, [Codebook.of(b) for b in books], length, scale).toLocalIterator():
            books[row["part"]][row["entry"], row["pos"]] = int(row["total"]) // row["n"]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], length: int, scale: int = SCALE) -> DataFrame:
    """__id, __label, code (entries' indexes, two hexadecimal digits each), error of rows with vectors of `length`."""
    shared = vectors.sparkSession.sparkContext.broadcast([Codebook.of(b) for b in books])
    size = length // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in shared.value]
        for batch in batches:
            for part, rows in _batches(batch, 2, length, scale):
                found = [memo.nearest(rows[:, p * size : (p + 1) * size]) for p, memo in enumerate(memos)]
                codes = [bytes(c).hex() for c in np.stack([e for e, _ in found], axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], names=["__id", "__label", "code", "error"])

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("__id", "__label")]
    return vectors.select("__id", "__label", "vector").mapInArrow(run, f"__id {kinds[0]}, __label {kinds[1]}, code string, error long")


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def quantise(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows id_col, code, error, label_error, codebooks_sha256; the codebooks), the codes written to the checkpoint folder."""
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    vectors = usable(df, id_col, vector_col, label_col)
    lengths = vectors.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    length = lengths["length"] if lengths else 0
    blank = vectors.select("__id", "__label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    books: list[np.ndarray] = []
    if length and length % parts == 0:
        books = train(vectors, length, parts, entries, rounds, scale)
        coded = encode(vectors.where(F.size("vector") == length), books, length, scale)
        coded = coded.unionByName(blank.where(F.size("vector") != length))
    else:
        coded = blank
    coded = cut(coded)
    sums = coded.groupBy("__label").agg(F.sum("error").alias("label_error")).withColumnRenamed("__label", "__key")
    out = coded.join(if_small(sums), F.col("__label").eqNullSafe(F.col("__key")), "left")
    return out.select(F.col("__id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")), books
