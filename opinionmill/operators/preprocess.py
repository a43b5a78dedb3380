"""The composite cleaning step with its four switches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .vocabulary import lemmatize, stem_tokens


def preprocess(
    df: DataFrame,
    text_col: str,
    out_col: str = "processed_text",
    remove_stopwords: bool = True,
    perform_stemming: bool = False,
    perform_lemmatization: bool = True,
    handle_negations: bool = True,
    id_col: str | None = None,
    lexicon: DataFrame | None = None,
    mode: str = "verb_noun",
    word_boundary: bool = False,
) -> DataFrame:
    """Adds the cleaned text.

    Without a lexicon or stemming this is one expression and no shuffle.
    Lemmas need a lexicon, lemmas and stems an `id_col` with unique values;
    stems are made only when lemmatisation is off.
    """
    stemming, lemmas = perform_stemming and not perform_lemmatization, perform_lemmatization and lexicon is not None
    found = T.tokens(F.col(text_col), remove_stopwords, handle_negations, word_boundary)
    if not (stemming or lemmas):
        return df.withColumn(out_col, T.rejoin(found))
    if id_col is None:
        raise ValueError("lemmas and stems need an id column")
    rows = df.withColumn("__list", found)
    rows = lemmatize(rows, id_col, "__list", lexicon, mode) if lemmas else stem_tokens(rows, id_col, "__list")
    return rows.withColumn(out_col, T.rejoin(F.col("__list"))).drop("__list")
