"""Lemmas and stems as vocabulary jobs: each distinct token is looked up or stemmed once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.stem import stem
from .joins import word_join


def _replace(df: DataFrame, id_col: str, tokens_col: str, mapped: DataFrame) -> DataFrame:
    """Tokens replaced through (form, other), order kept; forms without an entry stay."""
    spread = df.select(id_col, F.posexplode(tokens_col).alias("__at", "form"))
    found = word_join(spread, mapped, "form", id_col, "left").select(id_col, F.struct("__at", F.coalesce("other", "form").alias("t")).alias("__t"))
    back = found.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list("__t")), lambda x: x["t"]).alias("__tokens"))
    return df.join(back, id_col, "left").withColumn(tokens_col, F.coalesce("__tokens", F.array().cast("array<string>"))).drop("__tokens")


def lemmatize(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame | None, mode: str = "verb_noun") -> DataFrame:
    """Tokens as lemmas from a lexicon (form, pos 'v' or 'n', lemma).

    `verb_noun` takes the verb's lemma if it differs from the form, else the
    noun's; `noun` the noun's alone.  Ids must be unique.  Without a lexicon
    the frame is returned as it is.
    """
    if mode not in ("verb_noun", "noun"):
        raise ValueError(f"unknown mode {mode!r}")
    if lexicon is None:
        return df
    verb = F.max(F.when((F.col("pos") == "v") & (F.col("lemma") != F.col("form")), F.col("lemma")))
    noun = F.max(F.when(F.col("pos") == "n", F.col("lemma")))
    other = F.coalesce(verb, noun) if mode == "verb_noun" else noun
    return _replace(df, id_col, tokens_col, lexicon.groupBy("form").agg(other.alias("other")))


@F.pandas_udf(StringType())
def _stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in words:
        yield batch.map(stem)


def stem_tokens(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """Tokens as Porter stems; the stemmer runs on the distinct tokens only.  Ids must be unique."""
    forms = df.select(F.explode(tokens_col).alias("form")).distinct()
    return _replace(df, id_col, tokens_col, forms.withColumn("other", _stems("form")))
