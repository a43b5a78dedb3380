"""Data-quality and distribution tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.labels import normalise
from .quantiles import exact_quantiles


def complete(df: DataFrame, text_col: str, sentiment_col: str) -> DataFrame:
    """Rows with both a text and a label."""
    return df.na.drop(subset=[text_col, sentiment_col])


def sentiment_distribution(df: DataFrame, sentiment_col: str) -> DataFrame:
    """sentiment, n, percent (one decimal), the most frequent first.  Totals come from the grouped rows."""
    counts = df.groupBy(F.col(sentiment_col).alias("sentiment")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("sentiment", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent")).orderBy(F.desc("n"), "sentiment")


def missing_profile(df: DataFrame, *columns: str) -> DataFrame:
    """column, missing, ratio."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{k}") for k, c in enumerate(columns)])
    each = [F.struct(F.lit(c).alias("column"), F.col(f"m{k}").alias("missing"), F.coalesce(F.col(f"m{k}") / F.expr("nullif(n, 0)"), F.lit(0.0)).alias("ratio")) for k, c in enumerate(columns)]
    return row.select(F.inline(F.array(*each)))


def with_text_length(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("text_length", F.length(text_col))


def text_length_stats(df: DataFrame, text_col: str, approximate: bool = False) -> DataFrame:
    """n, mean, std, min, p25, p50, p75, max of text lengths, null texts left out.

    Exact quartiles come from a few passes with bounded buffers; `approximate`
    ones from a sketch in the same pass as the rest.
    """
    size = F.length(text_col)
    shares = [0.25, 0.5, 0.75]
    if approximate:
        quartiles = F.percentile_approx(size, shares, 10_000)
    else:
        found = exact_quantiles(df, size, shares)
        quartiles = F.array(*[F.lit(q).cast("double") for q in found or [None] * 3])
        quartiles = F.first(quartiles)
    row = df.agg(
        F.count(size).alias("n"), F.avg(size).alias("mean"), F.stddev_samp(size).alias("std"), F.min(size).alias("min"), F.max(size).alias("max"), quartiles.alias("q")
    )
    return row.select("n", "mean", "std", "min", F.col("q")[0].cast("double").alias("p25"), F.col("q")[1].cast("double").alias("p50"), F.col("q")[2].cast("double").alias("p75"), "max")


def short_texts(df: DataFrame, text_col: str, sentiment_col: str, below: int = 5) -> DataFrame:
    """Texts shorter than `below` characters: text, sentiment, text_length."""
    return with_text_length(df, text_col).where(F.col("text_length") < below).select(text_col, sentiment_col, "text_length")


def class_list(df: DataFrame, sentiment_col: str) -> DataFrame:
    """All classes after normalisation, sorted."""
    return df.select(normalise(F.col(sentiment_col)).alias("label")).distinct().orderBy("label")


def keep_classes(df: DataFrame, label_col: str, classes: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Rows whose label is among `classes` (column label).

    `dropped` observes `kept` and `dropped` rows while the result is computed,
    without a job of its own.
    """
    known = classes.select(F.col("label").alias(label_col)).distinct()
    if dropped is None:
        return df.join(known, label_col, "left_semi")
    marked = df.join(known.withColumn("__known", F.lit(True)), label_col, "left")
    counted = marked.observe(dropped, F.count_if("__known").alias("kept"), F.count_if(F.col("__known").isNull()).alias("dropped"))
    return counted.where("__known").select(*df.columns)


def binary_only(df: DataFrame, label_col: str) -> DataFrame:
    """Positive and negative rows; an error if there are none."""
    kept = df.where(F.col(label_col).isin("positive", "negative"))
    if kept.isEmpty():
        raise ValueError("no positive or negative rows")
    return kept


def smallest_class(df: DataFrame, label_col: str) -> DataFrame:
    """label and n of the rarest class."""
    return df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")).orderBy("n", "label").limit(1)


def check_classes(df: DataFrame, label_col: str, least: int = 2) -> None:
    """At least two classes, each with `least` rows."""
    # The rarest classes decide, however many there are.
    rarest = df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")).orderBy("n", "label").limit(2).collect()
    if len(rarest) < 2:
        raise ValueError(f"classification needs two classes, found {[str(r['label']) for r in rarest]}")
    if rarest[0]["n"] < least:
        raise ValueError(f"class {rarest[0]['label']!r} has {rarest[0]['n']} rows; {least} are needed")


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """label, n, weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))


def with_weights(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """Adds each row's class weight; there is one row a class to look it up in."""
    weights = class_weights(df, label_col).select(F.col("label").alias(label_col), F.col("weight").alias(weight_col))
    return df.join(F.broadcast(weights), label_col)
