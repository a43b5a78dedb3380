"""Column names and roles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name parts that mark a role, in order of preference.
TEXT_NAMES = ["review", "text", "comment", "feedback", "description", "content", "message"]
SENTIMENT_NAMES = ["sentiment", "label", "rating", "score", "class", "polarity", "emotion", "star"]
# Exact names tried for the default choice.
DEFAULT_TEXT = ["review_text", "text", "review", "comment", "content"]
DEFAULT_SENTIMENT = ["sentiment", "label", "rating", "score"]


def unique_names(names: Sequence[str]) -> tuple[list[str], dict[int, tuple[str, str]]]:
    """Names with repeats numbered `x, x_1, x_2`, and the renamed positions; a number in use is passed over.

    Names that differ in the case of letters only are repeats, as Spark can't tell them apart.
    """
    taken, seen, out, renamed = {n.lower() for n in names}, set(), [], {}
    for k, name in enumerate(names):
        new = name
        if name.lower() in seen:
            n = 1
            while f"{name}_{n}".lower() in taken:
                n += 1
            new = f"{name}_{n}"
            taken.add(new.lower())
            renamed[k] = (name, new)
        seen.add(name.lower())
        out.append(new)
    return out, renamed


def deduplicate_columns(df: DataFrame) -> tuple[DataFrame, dict[int, tuple[str, str]], bool]:
    """The frame with unique names, the renames by position, and whether there were any."""
    names, renamed = unique_names(df.columns)
    return (df.toDF(*names) if renamed else df), renamed, bool(renamed)


#: Base 2 logarithm of a sketch's buckets; a sketch's estimate is off by 1.04 / sqrt(buckets), 1.6 %, in the mean.
SKETCH = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH / 2)


def column_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """column, type, n, distinct, mean_length (of the non-null values' text), one row a column, from one aggregate.

    `exact` counts of different values shuffle them all; otherwise distinct is
    the estimate of a mergeable sketch of fixed size.
    """
    parts = []
    for k, f in enumerate(df.schema.fields):
        value = F.col(f"`{f.name}`")
        distinct = F.count_distinct(value) if exact else F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(value.cast("string"), SKETCH)), F.lit(0))
        parts += [F.count(value).alias(f"n{k}"), distinct.alias(f"d{k}"), F.avg(F.length(value.cast("string"))).alias(f"m{k}")]
    row = df.agg(*parts)
    each = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{k}").alias("n"), F.col(f"d{k}").alias("distinct"), F.col(f"m{k}").alias("mean_length"))
        for k, f in enumerate(df.schema.fields)
    ]
    return row.select(F.inline(F.array(*each)))


def _by_name(columns: Sequence[str], parts: Sequence[str]) -> str | None:
    return next((c for p in parts for c in columns if p in c.lower()), None)


def _counted_near_limits(df: DataFrame, estimates: dict[str, int], limit: float) -> dict[str, int]:
    """Estimates of different values, exact where a decision could turn on the error: near 5, near the limit, near another column's."""
    slack = 5 * SKETCH_ERROR
    alike = lambda c, x: any(abs(x - y) <= slack * (x + y) for other, y in estimates.items() if other != c)
    near = [c for c, x in estimates.items() if x <= 5 * (1 + slack) or abs(x - limit) <= slack * limit or alike(c, x)]
    if not near:
        return estimates
    row = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"d{k}") for k, c in enumerate(near)]).first()
    return estimates | {c: row[f"d{k}"] for k, c in enumerate(near)}


def detect_columns(df: DataFrame, variant: str = "full") -> tuple[str | None, str | None]:
    """(text, sentiment) columns, by name, then by content.

    Content is profiled in one aggregate, and only if a name left a role open;
    different values are estimated by sketches, and counted only for columns
    whose estimate is within five errors of a limit or of another column's.
    `full` also takes the column with the fewest values of any type; `chunk`
    takes the second column instead.
    """
    columns = df.columns
    text, sentiment = _by_name(columns, TEXT_NAMES), _by_name(columns, SENTIMENT_NAMES)
    if text is not None and sentiment is not None or not columns:
        return text, sentiment
    stats = {r["column"]: r for r in column_stats(df, exact=False).collect()}
    n_rows = df.count()
    counted = _counted_near_limits(df, {c: r["distinct"] for c, r in stats.items()}, max(10, 0.1 * n_rows))
    is_text = {f.name: isinstance(f.dataType, T.StringType) for f in df.schema.fields}
    is_number = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    mean = lambda c: stats[c]["mean_length"] or 0.0
    distinct = lambda c: counted[c]
    for c in columns:
        if c == sentiment:
            continue
        if text is None and is_text[c] and mean(c) > 20:
            text = c
        elif sentiment is None and c != text and not is_text[c] and distinct(c) <= 5:
            sentiment = c
    if text is None:
        strings = [c for c in columns if is_text[c] and c != sentiment]
        text = (columns[0] if variant == "chunk" else None) or (max(strings, key=mean) if strings else columns[0])
    if sentiment is None:
        numbers = [c for c in columns if is_number[c] and c != text]
        few = [c for c in numbers if distinct(c) < max(10, 0.1 * n_rows)]
        if few or numbers:
            sentiment = min(few, key=distinct) if few else numbers[0]
        else:
            rest = [c for c in columns if c != text]
            if rest:
                sentiment = (columns[1] if len(columns) > 1 and columns[1] != text else rest[0]) if variant == "chunk" else min(rest, key=distinct)
    return text, sentiment


def default_columns(columns: Sequence[str]) -> tuple[str | None, str | None]:
    """Default choice from exact names, else the first and the second column."""
    lower = {c.lower(): c for c in reversed(columns)}
    text = next((lower[n] for n in DEFAULT_TEXT if n in lower), columns[0] if columns else None)
    sentiment = next((lower[n] for n in DEFAULT_SENTIMENT if n in lower), columns[1] if len(columns) > 1 else None)
    return text, sentiment


def check_columns(df: DataFrame, text_col: str, sentiment_col: str) -> None:
    """Both must exist and differ, and the text be a string column."""
    for c in (text_col, sentiment_col):
        if c not in df.columns:
            raise ValueError(f"no column {c!r}; there are {df.columns}")
    if text_col == sentiment_col:
        raise ValueError("text and sentiment are the same column")
    if not isinstance(df.schema[text_col].dataType, T.StringType):
        raise ValueError(f"{text_col!r} is no text column")


def preview(df: DataFrame, n_rows: int = 10, n_columns: int | None = None) -> DataFrame:
    """First rows and columns under unique names."""
    df, _, _ = deduplicate_columns(df)
    return df.select(*[f"`{c}`" for c in df.columns[:n_columns]]).limit(n_rows)


def with_prefix(df: DataFrame, keep: Sequence[str], prefix: str = "confidence_") -> DataFrame:
    """The named columns and those with a prefix."""
    return df.select(*keep, *[c for c in df.columns if c.startswith(prefix) and c not in keep])
