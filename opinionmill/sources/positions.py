"""Row positions in file order, from counts of each file range plus offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, position_col: str = "position") -> DataFrame:
    """Adds each row's position, from 0, in the order of files by path and of rows in them.

    `df` comes straight from files (no shuffle in between).  A task reads the
    rows of a file range one after the other, so a row's place in its range
    follows from a growing number; only the ranges' counts, one row each, are
    summed up.  Rows are neither sorted nor shuffled; the file list must not
    change while this runs.
    """
    path, start, number = (f"__{position_col}_{x}" for x in ("path", "start", "number"))
    rows = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(start), F.monotonically_increasing_id().alias(number))
    ranges = rows.groupBy(path, start).agg(F.count("*").alias("n"), F.min(number).alias("first"))
    # One row a file range: their order is one task's, as the list of files is the driver's.
    ahead = Window.orderBy(path, start).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(path, start, "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = rows.join(F.broadcast(offsets), [path, start])
    return placed.select(*[placed[c] for c in df.columns], (F.col("ahead") + F.col(number) - F.col("first")).alias(position_col))
