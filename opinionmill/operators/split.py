"""Reproducible splits and samples, by MD5 order of an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import order_key, ranked


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: in each class the first ceil(n * test_size) rows in the key's order."""
    return ranked(df, id_col, [label_col], seed).withColumn("is_test", F.col("__rank") <= F.ceil(F.col("__n") * F.lit(test_size))).drop("__rank", "__n")


def hash_share(id_col: str, seed: int = 42) -> Column:
    """A number in [0, 1) from the key's first eight hexadecimal digits; it needs no other row, so streams can use it."""
    return F.conv(F.substring(order_key(id_col, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_split(df: DataFrame, id_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test by the id's hash alone."""
    return df.withColumn("is_test", hash_share(id_col, seed) < test_size)


def capped_evaluation(df: DataFrame, id_col: str, cap: int = 10_000, seed: int = 42) -> DataFrame:
    """At most `cap` test rows, the first in the key's order."""
    return df.where("is_test").orderBy(order_key(id_col, seed), id_col).limit(cap)


def tuning_subset(df: DataFrame, id_col: str, label_col: str, n: int = 10_000, beyond: int = 20_000, seed: int = 42) -> DataFrame:
    """Above `beyond` rows exactly n, each class in proportion (largest remainders, ties by label); else all rows."""
    total = df.count()
    if total <= beyond:
        return df
    quota = _quotas(df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")), n, total)
    rows = ranked(df, id_col, [label_col], seed)
    return rows.join(F.broadcast(quota.withColumnRenamed("label", "__label")), rows[label_col].eqNullSafe(F.col("__label"))).where("__rank <= quota").select(*df.columns)


def _quotas(counts: DataFrame, n: int, total: int) -> DataFrame:
    """label, quota for a table with one row a class."""
    from pyspark.sql import Window

    exact = F.col("n") * F.lit(n) / F.lit(total)
    rows = counts.select("label", F.floor(exact).alias("low"), (exact - F.floor(exact)).alias("rest"))
    rows = rows.withColumn("k", F.row_number().over(Window.orderBy(F.desc(F.round("rest", 9)), "label"))).withColumn("open", F.lit(n) - F.sum("low").over(Window.partitionBy()))
    return rows.select("label", (F.col("low") + F.when(F.col("k") <= F.col("open"), 1).otherwise(0)).alias("quota"))


def folds(df: DataFrame, id_col: str, label_col: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Adds fold, 0 to k - 1, each class dealt round in the key's order."""
    return ranked(df, id_col, [label_col], seed).withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank", "__n")


def bernoulli_sample(df: DataFrame, id_col: str, percent: float, seed: int = 42) -> DataFrame:
    """Every row with probability percent/100, decided by its hash."""
    return df.where(hash_share(id_col, seed) < percent / 100)


def exact_sample(df: DataFrame, id_col: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """Exactly n rows, by default min(1000, 1 %)."""
    if n is None:
        n = min(1000, df.count() // 100)
    return df.orderBy(order_key(id_col, seed), id_col).limit(n)


def thinned(df: DataFrame, id_col: str, label_col: str, share: float = 0.5, seed: int = 42) -> DataFrame:
    """A share of the rows by hash, for training on less than all; apply it after labels are normalised."""
    return df.where(F.col(label_col).isNotNull() & (hash_share(id_col, seed) < share))


def thinned_by_position(df: DataFrame, position_col: str = "position", chunk_rows: int = 20_000, least: int = 10) -> DataFrame:
    """A quarter of the chunks of a large file, `least` at least: a first and a last third of them whole, in between every so many.

    Chunks are runs of `chunk_rows` rows by position (see
    `sources.positions.with_positions`); whether a row stays follows from its
    position and the number of rows alone.
    """
    total = max(1, df.count() // chunk_rows)
    kept = max(least, total // 4)
    edge = kept // 3
    middle = (total - 2 * edge) // (kept - 2 * edge)
    chunk = F.floor(F.col(position_col) / chunk_rows)
    if middle <= 1:
        return df
    return df.where((chunk <= edge) | (chunk >= total - edge) | ((chunk - edge) % middle == 0))
