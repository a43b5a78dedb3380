"""Joins of many rows with a table of words, some of which are in a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most, and parts that a word's rows are dealt to beyond that.
BROADCAST_ROWS, SALTS = 150_000, 16


def word_join(rows: DataFrame, table: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """`rows` joined with a table that has few rows for each key.

    The table is counted first: a small one is broadcast; a larger one is
    repeated SALTS times and a key's rows are dealt out by another column, so
    that a frequent word is many tasks' work.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    parts = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(parts, [key, "__salt"], how).drop("__salt")


def text_join(texts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`texts` joined with a table of small rows, whose keys are unique; the long rows are never sorted.

    The table is counted first: a small one is broadcast; of a larger one each
    task holds its share while the texts pass by.
    """
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(table) if few else table.hint("shuffle_hash"), key)
