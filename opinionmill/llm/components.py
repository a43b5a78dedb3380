"""Connected components of a graph given as links, by contraction in parts and alternating star contractions.

Each part of the links, of PART_LINKS or fewer, is contracted by itself to stars
around its smallest nodes.  Links that fit in one part are done then.  For more,
large-star links every larger neighbour of a node to the smallest node of its
neighbourhood, small-star does the same for the smaller ones; both are one
grouped minimum and one join, and after a logarithmic number of rounds each
component is a star around its smallest node.  Nothing is gathered outside the
shuffle; each round's links are cut off through the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60
#: Links that one task contracts, some 50 MB there.
PART_LINKS = 200_000


def _print(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


class Forest:
    """Union-find over integers; the smallest of a set is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x], x = root, y
        return root

    def join(self, a: int, b: int) -> None:
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        """Every joined element with its root."""
        return [(x, self.find(x)) for x in list(self.up)]


def _contracted(links: DataFrame) -> DataFrame:
    """u, v: each partition's links as stars around the smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns)):
                forest.join(forest.find(u), forest.find(v))
        found = forest.stars()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """node, component for every node in `links` (columns a, b); component is its smallest node."""
    links = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    parts = -(-links.count() // PART_LINKS)
    if parts:
        links = cut(_contracted(links.coalesce(parts)))
    if parts > 1:
        links = _settled(links.distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _settled(links: DataFrame) -> DataFrame:
    """The rounds of star contractions."""
    before, after = None, _print(links)
    for _ in range(MAX_ROUNDS):
        if after == before or not after[0]:
            return links
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links, before = cut(small.distinct()), after
        after = _print(links)
    raise RuntimeError("components did not settle")
