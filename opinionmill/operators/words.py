"""Word counts, top words, term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_counts(df: DataFrame, tokens_col: str, by: str) -> DataFrame:
    """by, word, n."""
    return df.select(by, F.explode_outer(tokens_col).alias("word")).where(F.col("word").isNotNull()).groupBy(by, "word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, tokens_col: str, by: str, n: int = 15) -> DataFrame:
    """The n most frequent words of each group with their rank; ties go by word."""
    order = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    return word_counts(df, tokens_col, by).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cloud_weights(df: DataFrame, tokens_col: str, by: str, value: str | None = None, n: int = 100) -> DataFrame:
    """The n most frequent words of each group, or of one, weighed relative to the group's most frequent."""
    rows = df if value is None else df.where(F.col(by) == value)
    return top_words(rows, tokens_col, by, n).withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(by)))


def term_counts(df: DataFrame, id_col: str, terms_col: str) -> DataFrame:
    """id, term, tf.

    The outer explode keeps the optimiser from testing the list for emptiness
    under a join, which would evaluate its whole expression a second time.
    """
    spread = df.select(F.col(id_col).alias("id"), F.explode_outer(terms_col).alias("term")).where(F.col("term").isNotNull())
    return spread.groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = 5, max_df: float = 0.8, max_features: int | None = 5000) -> DataFrame:
    """term, df, ctf of the terms kept, from id, term, tf."""
    return kept_terms(counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")), n_docs, min_df, max_df, max_features)


def kept_terms(totals: DataFrame, n_docs: int, min_df: int = 5, max_df: float = 0.8, max_features: int | None = 5000) -> DataFrame:
    """The rows (term, df, ctf) kept: in min_df documents or more, in max_df of all or less, then the most frequent."""
    found = totals.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    return found if max_features is None else found.orderBy(F.desc("ctf"), "term").limit(max_features)


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k in n at a share p, which is kept off 0."""
    low = F.lit(1e-10)
    return F.log(F.greatest(p, low)) * k + F.log(F.greatest(1 - p, low)) * (n - k)


def pair_scores(df: DataFrame, tokens_col: str, by: str) -> DataFrame:
    """by, first, second, n, score of neighbouring words: twice the log-likelihood ratio of the second word depending on the first.

    Three counts decide: of the pair, of each word, and of all words of the group.
    """
    spots = F.when(F.size(tokens_col) > 1, F.sequence(F.lit(1), F.size(tokens_col) - 1)).otherwise(F.array().cast("array<int>"))
    pairs = df.select(by, F.explode(F.transform(spots, lambda i: F.struct(F.element_at(tokens_col, i).alias("first"), F.element_at(tokens_col, i + 1).alias("second")))).alias("p"))
    pairs = pairs.groupBy(by, "p.first", "p.second").agg(F.count("*").alias("n"))
    singles = word_counts(df, tokens_col, by)
    total = singles.groupBy(by).agg(F.sum("n").alias("all"))
    rows = pairs.join(singles.select(by, F.col("word").alias("first"), F.col("n").alias("n1")), [by, "first"])
    rows = rows.join(singles.select(by, F.col("word").alias("second"), F.col("n").alias("n2")), [by, "second"]).join(F.broadcast(total), by)
    both, one, two, whole = (F.col(c).cast("double") for c in ("n", "n1", "n2", "all"))
    apart = F.when(whole > one, (two - both) / (whole - one)).otherwise(F.lit(0.0))
    alike = _likelihood(both, one, two / whole) + _likelihood(two - both, whole - one, two / whole)
    unlike = _likelihood(both, one, both / one) + _likelihood(two - both, whole - one, apart)
    return rows.select(by, "first", "second", "n", (-2 * (alike - unlike)).alias("score"))


def cloud_phrases(df: DataFrame, tokens_col: str, by: str, n: int = 100, threshold: float = 30.0) -> DataFrame:
    """by, word, n, rank, weight like cloud_weights, with pairs that score above the threshold as words of their own.

    A kept pair's occurrences no longer count for its two words; words that
    have none left are dropped.
    """
    kept = pair_scores(df, tokens_col, by).where(F.col("score") > threshold)
    spent = kept.select(by, F.explode(F.array("first", "second")).alias("word"), (-F.col("n")).alias("n"))
    singles = word_counts(df, tokens_col, by).unionByName(spent).groupBy(by, "word").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    rows = singles.unionByName(kept.select(by, F.concat_ws(" ", "first", "second").alias("word"), "n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(by)))
