"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within a squared distance of 2 - 2c.
The vectors are rotated to the principal axes of a bounded sample and split
into blocks of few dimensions; the squared distance is the sum over the blocks,
so if each block has a share of the budget, in proportion to its share of the
variance, a pair within the whole budget is within its share in one block at
least.  Each block is range-joined by itself: a tree of boxes split at sample
medians deals the vectors out, a vector descends to every lower-numbered box
that its share reaches, and within a box block distances come from matrix
products.  The number of boxes grows with the table, and the sample with it.  A pair is
verified, exactly and in double precision, in the first block that finds it,
so the union of the blocks needs no deduplication.

Equal vectors are one class with a weight.  A box that many vectors share is
dealt out in salted parts, and parts meet pairwise.  Tasks return for each
class its number of linked vectors and one link of a spanning forest, never
the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't compare, and there may be
any number of lengths; repeated rows are linked with each other, like any equal
vectors; an id with several vectors has the most links that one of them has, and
the smallest component; null ids link with nothing; ids that are no integers are an error;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Sampled vectors for axes and boxes, at least; sampled vectors for each box; components of a sample, at most.
SAMPLE, SAMPLED_A_BOX, SAMPLE_VALUES = 4096, 4, 1 << 23
#: Dimensions of a block, vectors a box should hold.
BLOCK_DIMS, BOX_ROWS = 16, 8192
#: Vectors and components in one part of a crowded box, vectors of one matrix product, pairs verified at once.
PART_ROWS, PART_VALUES, TILE, PAIRS = 16_384, 1 << 22, 1024, 16_384
#: The most usual vector lengths have axes and boxes of their own, and so have all with more vectors than a box.
OWN_LENGTHS = 64


@dataclass
class Layout:
    """Axes (none: as they are), blocks as column ranges, each block's budget and tree of boxes.

    A tree is a list of levels, each with its boxes' lower and upper corners;
    box k of a level is split into boxes 2k and 2k + 1 of the next one.
    """

    axes: np.ndarray | None
    blocks: list[tuple[int, int]]
    budgets: list[float]
    trees: list[list[tuple[np.ndarray, np.ndarray]]]


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _tree(points: np.ndarray, n_boxes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of boxes that tile the space, from median splits along the widest dimension."""
    d = points.shape[1]
    parts = [(points, np.full(d, -np.inf), np.full(d, np.inf))]
    levels = []
    while True:
        levels.append((np.array([p[1] for p in parts]), np.array([p[2] for p in parts])))
        if len(parts) >= n_boxes:
            return levels
        split = []
        for part, low, high in parts:
            axis = int(np.argmax(part.std(axis=0))) if len(part) > 1 else 0
            # A box without points is split where it stays a box.
            at = float(np.median(part[:, axis])) if len(part) else max(low[axis], min(high[axis], 0.0))
            left_high, right_low = high.copy(), low.copy()
            left_high[axis] = right_low[axis] = at
            split += [(part[part[:, axis] < at], low, left_high), (part[part[:, axis] >= at], right_low, high)]
        parts = split


def _descend(x: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]], budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, box and whether it is the row's own, for the boxes within the budget up to the own one."""
    row, box, home = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
    for low, high in tree[1:]:
        row, box, home = np.repeat(row, 2), (np.repeat(2 * box, 2).reshape(-1, 2) + [0, 1]).ravel(), np.repeat(home, 2)
        gap = np.maximum(np.maximum(low[box] - x[row], x[row] - high[box]), 0)
        home &= ((x[row] >= low[box]) & (x[row] < high[box])).all(axis=1)
        near = home | ((gap * gap).sum(axis=1) <= budget)
        row, box, home = row[near], box[near], home[near]
    own = np.empty(len(x), dtype=np.int64)
    own[row[home]] = box[home]
    before = box <= own[row]
    return row[before], box[before], home[before]


def plan(sample: np.ndarray, total: int, cosine: float) -> Layout:
    x = unit(sample)
    values, vectors = np.linalg.eigh(np.cov(x.T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1]))
    axes = vectors[:, ::-1]
    energy = np.maximum(values[::-1], 1e-12)
    d = x.shape[1]
    n_blocks = max(1, round(d / BLOCK_DIMS))
    edges = [round(k * d / n_blocks) for k in range(n_blocks + 1)]
    blocks = list(zip(edges, edges[1:]))
    shares = np.array([energy[a:b].sum() for a, b in blocks])
    # A little slack keeps rounding from costing a pair; what it lets in is verified.
    budgets = ((2 - 2 * cosine) * shares / shares.sum() * (1 + 1e-9) + 1e-12).tolist()
    # A sample that can't grow further splits into as many boxes as it has points for.
    n_boxes = min(_box_count(total), 1 << max(0, int(log2(max(1, len(x) / SAMPLED_A_BOX)))))
    return Layout(axes, blocks, budgets, [_tree((x @ axes)[:, a:b], n_boxes) for a, b in blocks])


def _box_count(total: int) -> int:
    return 1 << max(0, ceil(log2(max(1, total / BOX_ROWS))))


def _sampled(classes: DataFrame, length: int, total: int) -> np.ndarray:
    """Vectors for the plan; their number follows the number of boxes, up to SAMPLE_VALUES components."""
    rows = min(max(SAMPLE, SAMPLED_A_BOX * _box_count(total)), max(SAMPLE_VALUES // length, 1))
    found = classes.orderBy(F.xxhash64("rep"), "rep").limit(rows).select("vector").toArrow().column(0).combine_chunks()
    return _matrix(found, length)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, length)


def _visits(classes: DataFrame, layout: Layout, length: int) -> DataFrame:
    """rep, weight, vector, block, box, home: a row for each class and box that it lives in or visits."""
    shared = classes.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.slice(first, 2048)
                rotated = unit(_matrix(part.column(2), length)) @ at.axes
                for block, (a, b) in enumerate(at.blocks):
                    row, box, home = _descend(rotated[:, a:b], at.trees[block], at.budgets[block])
                    found = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [*found.columns, pa.array(np.full(len(row), block)), pa.array(box), pa.array(home)],
                        names=["rep", "weight", "vector", "block", "box", "home"],
                    )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("rep", "weight", "vector").mapInArrow(run, f"rep long, weight long, vector {kind}, block long, box long, home boolean")


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of linked positions: labels become the smallest position of each component."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(labels, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _join(rows: DataFrame, layout: Layout | None, cosine: float) -> DataFrame:
    """rep, linked (vectors linked with it, found here), other (a class in its component) from each group of two parts.

    Without a layout a group's vectors are one block.  Rows: gid, side (0 and 1, or 2 for a part with itself), block, rep, weight, vector.
    """
    shared = rows.sparkSession.sparkContext.broadcast(layout)

    def pairs(group: dict[int, list], block: int, at: Layout | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        own = bool(group[2])
        left, right = (group[2], group[2]) if own else (group[0], group[1])
        if not left or not right:
            return None
        ids = np.array([r[0] for r in left] + ([] if own else [r[0] for r in right]))
        weight = np.array([r[1] for r in left] + ([] if own else [r[1] for r in right]), dtype=float)
        vectors = unit(np.array([r[2] for r in left] + ([] if own else [r[2] for r in right]), dtype=float))
        at = at or Layout(None, [(0, vectors.shape[1])], [(2 - 2 * cosine) * (1 + 1e-9) + 1e-12], [])
        rotated = vectors if at.axes is None else vectors @ at.axes
        a, b = at.blocks[block]
        # One product tells which pairs are near in this block: x.y - |x|^2/2 - |y|^2/2 is minus half their squared distance.
        x = rotated[:, a:b]
        half, one = -(x * x).sum(axis=1, keepdims=True) / 2, np.ones((len(ids), 1))
        rows_, columns_ = np.hstack([x, half, one]).astype(np.float32), np.hstack([x, one, half]).astype(np.float32)
        least = np.float32(-at.budgets[block] / 2 - 1e-5)
        linked, labels = np.zeros(len(ids)), np.arange(len(ids))
        n, start = len(left), 0 if own else len(left)

        def verify(p: np.ndarray, q: np.ndarray) -> None:
            """Single precision only proposes pairs; budgets and cosine are decided in double precision."""
            gap = rotated[p] - rotated[q]
            gap *= gap
            near = [gap[:, c:d].sum(axis=1) <= budget for (c, d), budget in zip(at.blocks[: block + 1], at.budgets)]
            hit = near[block] & ~np.any(near[:block], axis=0) if block else near[0]
            p, q = p[hit], q[hit]
            good = (vectors[p] * vectors[q]).sum(axis=1) >= cosine
            p, q = p[good], q[good]
            if len(p):
                np.add.at(linked, p, weight[q])
                np.add.at(linked, q, weight[p])
                _merge(labels, p, q)

        for i0 in range(0, n, TILE):
            i = slice(i0, min(i0 + TILE, n))
            for j0 in range(i0 if own else start, len(ids), TILE):
                close = rows_[i] @ columns_[j0 : j0 + TILE].T >= least
                p, q = np.divmod(np.flatnonzero(close), close.shape[1])
                p, q = p + i0, q + j0
                if own and i0 == j0:
                    p, q = p[p < q], q[p < q]
                for k in range(0, len(p), PAIRS):
                    verify(p[k : k + PAIRS], q[k : k + PAIRS])
        some = linked > 0
        return ids[some], linked[some].astype(np.int64), ids[labels[some]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, block, group = shared.value, None, 0, {0: [], 1: [], 2: []}

        def out():
            found = pairs(group, block, at) if key is not None else None
            if found is not None and len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["rep", "linked", "other"])

        for batch in batches:
            vectors, ends = np.asarray(batch.column(5).flatten()), np.cumsum([0, *batch.column(5).value_lengths().to_pylist()])
            for k, (gid, side, b, rep, weight) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]))):
                if gid != key:
                    yield from out()
                    key, block, group = gid, b, {0: [], 1: [], 2: []}
                group[side].append((rep, weight, vectors[ends[k] : ends[k + 1]]))
        yield from out()

    ordered = rows.select("gid", "side", "block", "rep", "weight", "vector").repartition("gid").sortWithinPartitions("gid")
    return ordered.mapInArrow(run, "rep long, linked long, other long")


def _groups(visits: DataFrame) -> DataFrame:
    """Deals every box's residents and visitors out to groups of two parts; long vectors make smaller parts."""
    room = F.greatest(F.lit(1.0), F.least(F.lit(float(PART_ROWS)), F.floor(F.lit(PART_VALUES) / F.max(F.size("vector")))))
    sizes = visits.groupBy("block", "box").agg(F.ceil(F.count_if("home") / room).alias("parts"), F.ceil(F.count_if(~F.col("home")) / room).alias("guests"))
    # Residents' part p meets itself, later resident parts, and every part of the visitors.
    dealt = visits.join(sizes, ["block", "box"]).withColumn("salt", F.xxhash64("rep", F.lit(3)))
    dealt = dealt.withColumn("part", F.when(F.col("home"), F.pmod("salt", "parts")).otherwise(F.pmod("salt", F.greatest("guests", F.lit(1)))))
    resident = F.concat(
        F.array(F.struct(F.col("part").alias("p"), F.lit("own").alias("with"), F.lit(-1).cast("long").alias("q"), F.lit(2).alias("side"))),
        F.expr("transform(filter(sequence(0L, parts - 1), q -> q > part), q -> named_struct('p', part, 'with', 'part', 'q', q, 'side', 0))"),
        F.expr("transform(filter(sequence(0L, parts - 1), q -> q < part), q -> named_struct('p', q, 'with', 'part', 'q', part, 'side', 1))"),
        F.expr("if(guests = 0, array(), transform(sequence(0L, greatest(guests, 1L) - 1), q -> named_struct('p', part, 'with', 'guest', 'q', q, 'side', 0)))"),
    )
    guest = F.expr("if(parts = 0, array(), transform(sequence(0L, greatest(parts, 1L) - 1), p -> named_struct('p', p, 'with', 'guest', 'q', part, 'side', 1)))")
    dealt = dealt.withColumn("g", F.explode(F.when(F.col("home"), resident).otherwise(guest)))
    return dealt.select(F.xxhash64("block", "box", "g.p", "g.with", "g.q").alias("gid"), "g.side", "block", "rep", "weight", "vector")


def near_duplicates(df: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each input row: id_col, n_links, component_id, kept."""
    rows = df.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vector").isNotNull() & F.col("__id").isNotNull() & finite & F.exists("vector", lambda x: x != 0)
    valid = rows.where(F.coalesce(good, F.lit(False)))
    # An id may have several vectors, so a class of equal ones is known by a number of its own, fixed by the checkpoint.
    classes = valid.groupBy("vector").agg(F.min("__id").alias("first"), F.count("*").alias("weight")).withColumn("length", F.size("vector"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    sizes = classes.groupBy("length").agg(F.count("*").alias("n"))
    # Lengths with more vectors than a box have boxes of their own; of the others the most usual ones do.
    own = sizes.where(F.col("n") > BOX_ROWS).collect()
    own += sizes.where(F.col("n") <= BOX_ROWS).orderBy(F.desc("n"), "length").limit(OWN_LENGTHS).collect()
    parts = []
    for length, total in own:
        same = classes.where(F.col("length") == length)
        layout = plan(_sampled(same, length, total), total, cosine)
        parts.append(_join(_groups(cut(_visits(same, layout, length))), layout, cosine))
    rest = sizes.join(F.broadcast(classes.sparkSession.createDataFrame(own, sizes.schema).select("length")), "length", "left_anti")
    if rest.head() is not None:
        # Any number of rare lengths, each a box by itself.
        rare = classes.join(rest.select("length"), "length").select("rep", "weight", "vector", F.lit(0).cast("long").alias("block"), F.col("length").cast("long").alias("box"), F.lit(True).alias("home"))
        parts.append(_join(_groups(cut(rare)), None, cosine))
    found = reduce(DataFrame.unionByName, parts) if parts else None
    members = valid.join(classes.select("vector", "rep", "weight"), "vector").select("__id", "rep", "weight")
    if found is None:
        return rows.select(F.col("__id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    links = found.where("rep != other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    labels = components(links)
    degree = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    by_class = (
        classes.select("rep", "weight", "first")
        .join(degree, "rep", "left")
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select("rep", "first", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    names = by_class.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = by_class.join(names, "component")
    linked = members.select("__id", "rep").join(by_class, "rep").select("__id", "n_links", "component_id").groupBy("__id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")
    )
    out = rows.select("__id").join(linked, "__id", "left")
    component = F.coalesce("component_id", "__id")
    return out.select(
        F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("__id")).alias("kept")
    )
