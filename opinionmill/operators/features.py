"""TF-IDF and hashed features, as rows (id, term, weight) and as Spark ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import text as T
from ..functions.stoplists import vectoriser_words
from ..session import stored
from .counting import by_length, by_vocabulary, ids_repeat, spread, term_totals
from .words import kept_terms, vocabulary

#: Words that n-grams are looked for among, at most; beyond them all n-grams are counted.
MAX_WORDS = 200_000


def terms(df: DataFrame, id_col: str, text_col: str, ngram_range: tuple[int, int] = (1, 2), stop_words: Sequence[str] | None = None) -> DataFrame:
    """id, terms: the n-grams of a cleaned text after the second stop list (None: the default, []: none)."""
    # The tokens are a column of their own: inside the n-gram lambda an expression would be evaluated for every position.
    return tokens(df, id_col, text_col, stop_words).select("id", T.ngrams(F.col("tokens"), *ngram_range).alias("terms"))


def tokens(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns to keep, tokens; a column that holds tokens already is taken as it is."""
    words = vectoriser_words() if stop_words is None else list(stop_words)
    if isinstance(df.schema[text_col].dataType, ArrayType):
        return df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("tokens"))
    found = T.analyse(F.col(text_col))
    found = T.remove_words(found, words) if words else found
    return df.select(F.col(id_col).alias("id"), *keep, found.alias("tokens"))


def cut_texts(df: DataFrame, id_col: str, text_col: str, stop_words: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns to keep, tokens as one string with blanks between them: for the operators that say so, much cheaper to write and to hand to tasks than lists."""
    return tokens(df, id_col, text_col, stop_words, keep).withColumn("tokens", F.array_join("tokens", " "))


def term_rows(df: DataFrame, id_col: str, text_col: str, ngram_range: tuple[int, int] = (1, 2), stop_words: Sequence[str] | None = None, keep: Sequence[str] = (), repeats: bool | None = None) -> DataFrame:
    """id, the columns to keep, term, tf.

    Counted row by row; only where ids repeat (`repeats`; None: told from the
    rows) are the counts of several rows added up.
    """
    found = spread(tokens(df, id_col, text_col, stop_words, keep), ngram_range)
    repeats = ids_repeat(df, id_col) if repeats is None else repeats
    return found.groupBy("id", *keep, "term").agg(F.sum("tf").alias("tf")) if repeats else found


def tfidf_rows(df: DataFrame, id_col: str, text_col: str, model: DataFrame, ngram_range: tuple[int, int] = (1, 2), stop_words: Sequence[str] | None = None, keep: Sequence[str] = (), repeats: bool | None = None, cut: bool = False) -> DataFrame:
    """id, the columns to keep, term, weight of texts, as `tfidf` weighs their counts; without a shuffle.

    The vocabulary, at most max_features terms, goes to the tasks with their
    function.  `cut`: the text comes from `cut_texts`, ids don't repeat.
    """
    if not cut and (ids_repeat(df, id_col) if repeats is None else repeats):
        return tfidf(term_rows(df, id_col, text_col, ngram_range, stop_words, keep, True), model)
    known = model.select("term", "idf").collect()
    inner = sorted({w for r in known if " " in r["term"] for w in r["term"].split(" ")})
    lists = df.select(F.col(id_col).alias("id"), *keep, text_col) if cut else tokens(df, id_col, text_col, stop_words, keep)
    return spread(lists, ngram_range, by_vocabulary([r["term"] for r in known], [r["idf"] for r in known]), inner)


def unit_rows(weights: DataFrame) -> DataFrame:
    """Weights divided by their row's Euclidean length."""
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return weights.withColumn("weight", F.col("weight") / norm)


def idf_of(df: Column, n_docs: int, use_idf: bool = True) -> Column:
    """Smoothed inverse document frequency: as if one more document had every term."""
    return F.log((1 + F.lit(n_docs)) / (1 + df)) + 1 if use_idf else F.lit(1.0)


def fit_tfidf(counts: DataFrame, n_docs: int, min_df: int = 5, max_df: float = 0.8, max_features: int = 5000, use_idf: bool = True) -> DataFrame:
    """term, df, ctf, idf of the vocabulary, at most max_features rows."""
    return vocabulary(counts, n_docs, min_df, max_df, max_features).withColumn("idf", idf_of(F.col("df"), n_docs, use_idf))


def fit_texts(
    df: DataFrame, id_col: str, text_col: str, n_docs: int, min_df: int = 5, max_df: float = 0.8, max_features: int | None = 5000, use_idf: bool = True, ngram_range: tuple[int, int] = (1, 2), stop_words: Sequence[str] | None = None, repeats: bool | None = None, cut: bool = False
) -> DataFrame:
    """term, df, ctf, idf of the vocabulary of texts or tokens, as `fit_tfidf` finds it from their counts.

    `cut`: the text comes from `cut_texts`, ids don't repeat.

    An n-gram is in no more documents and no more frequent than each of its
    words.  So words are counted first, and then only n-grams of words as
    frequent as the last one that would be kept: no others can be kept.
    """
    if not cut and (ids_repeat(df, id_col) if repeats is None else repeats):
        return fit_tfidf(term_rows(df, id_col, text_col, ngram_range, stop_words, repeats=True), n_docs, min_df, max_df, max_features, use_idf)
    lists = df.select(text_col) if cut else tokens(df, id_col, text_col, stop_words).select("tokens")
    low, high = ngram_range
    totals = None
    if low == 1 and high > 1 and max_features is not None:
        single = stored(term_totals(lists).where(F.col("df") >= min_df), "words")
        last = kept_terms(single, n_docs, min_df, max_df, max_features).agg(F.count("*").alias("n"), F.min("ctf").alias("ctf")).first()
        inner = single if last["n"] < max_features else single.where(F.col("ctf") >= last["ctf"])
        inner = [r["term"] for r in inner.select("term").limit(MAX_WORDS + 1).collect()]
        if len(inner) <= MAX_WORDS:
            longer = term_totals(lists, (2, high), inner)
            totals = single.unionByName(longer if last["n"] < max_features else longer.where(F.col("ctf") >= last["ctf"]))
    if totals is None:
        totals = term_totals(lists, ngram_range)
    return kept_terms(totals, n_docs, min_df, max_df, max_features).withColumn("idf", idf_of(F.col("df"), n_docs, use_idf))


def tfidf(counts: DataFrame, model: DataFrame) -> DataFrame:
    """id, term, weight: (1 + ln tf) * idf, rows of unit length.

    The vocabulary holds at most max_features terms and is broadcast.
    """
    found = counts.join(F.broadcast(model.select("term", "idf")), "term")
    keep = [c for c in counts.columns if c not in ("id", "term", "tf")]
    return unit_rows(found.select("id", *keep, "term", ((1 + F.log("tf")) * F.col("idf")).alias("weight")))


def fit_transform_tfidf(
    df: DataFrame, id_col: str, text_col: str, max_features: int = 5000, ngram_range: tuple[int, int] = (1, 2), use_idf: bool = True, min_df: int = 5, max_df: float = 0.8, stop_words: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(weights, vocabulary) of a cleaned text column; an error if no term is left.

    Tokens and vocabulary are written once and tokens are made into terms
    twice: the terms of all rows are several times as large as the texts.
    """
    rows = stored(tokens(df, id_col, text_col, stop_words), "tokens")
    repeats = ids_repeat(rows, "id")
    model = stored(fit_texts(rows, "id", "tokens", rows.count(), min_df, max_df, max_features, use_idf, ngram_range, stop_words, repeats), "vocabulary")
    if model.isEmpty():
        raise ValueError("no terms remain")
    return tfidf_rows(rows, "id", "tokens", model, ngram_range, stop_words, repeats=repeats), model


def hashed(df: DataFrame, id_col: str, text_col: str, n_features: int = 1 << 18, ngram_range: tuple[int, int] = (1, 1), by_term: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """id, the columns to keep, term (bucket, or the term itself), weight: counts in rows of unit length, no vocabulary and no stop list."""
    repeats = ids_repeat(df, id_col)
    if by_term and not repeats:
        return spread(tokens(df, id_col, text_col, [], keep), ngram_range, by_length)
    counts = term_rows(df, id_col, text_col, ngram_range, [], keep, repeats)
    if not by_term:
        bucket = F.pmod(F.hash("term"), F.lit(n_features)).cast("string")
        counts = counts.groupBy("id", *keep, bucket.alias("term")).agg(F.sum("tf").alias("tf"))
    return unit_rows(counts.select("id", *keep, "term", F.col("tf").cast("double").alias("weight")))


def feature_names(model: DataFrame | None) -> DataFrame | None:
    """idx, term of a vocabulary in alphabetical order; hashed features have no names.

    A vocabulary has at most max_features rows, so it is numbered in one task.
    """
    if model is None:
        return None
    return model.select((F.row_number().over(Window.orderBy("term")) - 1).alias("idx"), "term")


def _token_stages(text_col: str, ngram_range: tuple[int, int], stop_words: Sequence[str]) -> list:
    stages: list = [RegexTokenizer(inputCol=text_col, outputCol="__words", pattern=f"{T.WORD}{{2,}}", gaps=False, toLowercase=True)]
    stages.append(StopWordsRemover(inputCol="__words", outputCol="__n1", stopWords=list(stop_words) or [""]))
    names = ["__n1"] if ngram_range[0] == 1 else []
    for n in range(max(2, ngram_range[0]), ngram_range[1] + 1):
        stages.append(NGram(n=n, inputCol="__n1", outputCol=f"__n{n}"))
        names.append(f"__n{n}")
    return [*stages, SQLTransformer(statement=f"SELECT *, concat({', '.join(names)}) AS __terms FROM __THIS__")]


def hashing_stages(text_col: str = "processed_text", n_features: int = 1 << 18, ngram_range: tuple[int, int] = (1, 2), stop_words: Sequence[str] = ()) -> Pipeline:
    """Spark ML stages to unit-length hashed vectors in `features`."""
    return Pipeline(stages=[*_token_stages(text_col, ngram_range, stop_words), HashingTF(inputCol="__terms", outputCol="__tf", numFeatures=n_features), Normalizer(inputCol="__tf", outputCol="features", p=2.0)])
