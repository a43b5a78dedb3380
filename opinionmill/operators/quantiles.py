"""Exact quantiles of whole numbers in bounded memory.

The range of the values is cut into BINS bins and the bins are counted; the bins
that hold the ranks asked for are cut again, until a bin is one value.  Every
pass aggregates at most BINS counts for each rank, whatever the number of
values or of different ones; BINS ** passes spans the range.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def _refine(df: DataFrame, value: Column, spans: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Each rank's (low, high, values below low) after one more pass; spans that several ranks share are counted once."""
    different = sorted(set(spans.values()))
    widths = {s: max(1, -(-(s[1] - s[0] + 1) // BINS)) for s in different}
    parts = [F.when(value.between(s[0], s[1]), F.struct(F.lit(k).alias("span"), F.floor((value - s[0]) / widths[s]).alias("bin"))) for k, s in enumerate(different)]
    # Spans are equal or apart, so a value lies in one at most.
    counted = df.select(F.coalesce(*parts).alias("b")).where(F.col("b").isNotNull()).groupBy("b.span", "b.bin").agg(F.count("*").alias("n")).collect()
    bins: dict[int, list[tuple[int, int]]] = {}
    for r in counted:
        bins.setdefault(r["span"], []).append((r["bin"], r["n"]))
    out = {}
    for rank, span in spans.items():
        below = span[2]
        for at, n in sorted(bins[different.index(span)]):
            if rank < below + n:
                low = span[0] + at * widths[span]
                out[rank] = (low, min(span[1], low + widths[span] - 1), below)
                break
            below += n
    return out


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float] | None:
    """Interpolated quantiles of a whole-number column, nulls left out, as `percentile` gives them; None without values."""
    rows = df.select(value.cast("long").alias("v")).where(F.col("v").isNotNull())
    first = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
    if not first["n"]:
        return None
    places = [(first["n"] - 1) * s for s in shares]
    ranks = sorted({r for p in places for r in (floor(p), ceil(p))})
    spans = {r: (first["low"], first["high"], 0) for r in ranks}
    while any(low < high for low, high, _ in spans.values()):
        open_ = {r: s for r, s in spans.items() if s[0] < s[1]}
        spans |= _refine(rows, F.col("v"), open_)
    return [spans[floor(p)][0] + (p - floor(p)) * (spans[ceil(p)][0] - spans[floor(p)][0]) for p in places]
