"""Text cleaning and tokens as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stoplists import cleaning_words

# Unicode word and white-space classes, written out because Java's own are ASCII.
WORD = r"[\p{L}\p{N}_]"
BLANK = r"[\s\p{Z}]"
# ASCII punctuation without the underscore, and quotation marks that stand alone as tokens.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^`{|}~]"""
QUOTES = "[«»“”‘’„]"
# Words that a tokeniser splits in two.
SPLIT_WORDS = {"cannot": "can not", "gonna": "gon na", "gotta": "got ta", "wanna": "wan na", "gimme": "gim me", "lemme": "lem me"}


def blank_to_empty(text: Column) -> Column:
    """Null and blank texts become empty."""
    text = text.cast("string")
    return F.when(text.isNull() | text.rlike(f"^{BLANK}*$"), "").otherwise(text)


def join_negations(text: Column, word_boundary: bool = False) -> Column:
    """`not good` becomes `not_good`, `isn't good` `isnot_good`, any other `n't` ` not`.

    Without `word_boundary` the rule also fires inside words: `cannot do` becomes `cannot_do`.
    """
    lead = r"\b" if word_boundary else ""
    text = F.regexp_replace(text, f"{lead}not{BLANK}+({WORD}+)", "not_$1")
    text = F.regexp_replace(text, f"n't{BLANK}+({WORD}+)", "not_$1")
    return F.replace(text, F.lit("n't"), F.lit(" not"))


def strip_punctuation(text: Column, keep_underscore: bool = True) -> Column:
    text = F.regexp_replace(text, PUNCTUATION, " ")
    return text if keep_underscore else F.replace(text, F.lit("_"), F.lit(" "))


def clean(text: Column, handle_negations: bool = True, word_boundary: bool = False) -> Column:
    """Lower case, negations joined, punctuation to spaces."""
    out = F.lower(blank_to_empty(text))
    if handle_negations:
        out = join_negations(out, word_boundary)
    return strip_punctuation(out, keep_underscore=handle_negations)


def tokenize(text: Column) -> Column:
    """White-space tokens of cleaned text, contractions split and quotation marks apart."""
    out = F.regexp_replace(text, f"({QUOTES})", " $1 ")
    for word, parts in SPLIT_WORDS.items():
        out = F.regexp_replace(out, rf"\b{word}\b", parts)
    return F.filter(F.split(out, f"{BLANK}+"), lambda t: t != "")


def remove_words(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens that aren't listed, repeats kept."""
    return F.filter(tokens, lambda t: ~t.isin(list(words)))


def tokens(text: Column, remove_stopwords: bool = True, handle_negations: bool = True, word_boundary: bool = False) -> Column:
    """Tokens of a raw text after cleaning and the first stop list."""
    out = tokenize(clean(text, handle_negations, word_boundary))
    return remove_words(out, cleaning_words(keep_not=handle_negations)) if remove_stopwords else out


def rejoin(tokens_: Column) -> Column:
    return F.array_join(tokens_, " ")


def processed(text: Column, remove_stopwords: bool = True, handle_negations: bool = True, word_boundary: bool = False) -> Column:
    """The cleaned text as one string; stemming and lemmas are jobs of `operators.vocabulary`."""
    return rejoin(tokens(text, remove_stopwords, handle_negations, word_boundary))


def analyse(text: Column) -> Column:
    """Runs of two or more word characters, lower-cased: the tokens that features are made of."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD}{{2,}})"), 1)


def _runs(tokens_: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space."""
    spots = F.when(F.size(tokens_) >= n, F.sequence(F.lit(1), F.size(tokens_) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.array_join(F.slice(tokens_, i, n), " "))


def ngrams(tokens_: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of low to high tokens, joined by a space; pass a column, as an expression is evaluated at each position."""
    parts = [tokens_ if n == 1 else _runs(tokens_, n) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def split_lines(text: Column) -> Column:
    """One review for each line of a pasted text, outer white space removed."""
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n")


def human_size(n: Column) -> Column:
    """Bytes as text: B, KB, MB or GB, two decimals beyond bytes."""
    n = n.cast("double")
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.2f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.2f MB", n / 1024**2))
        .otherwise(F.format_string("%.2f GB", n / 1024**3))
    )
