"""CSV reading, strict and tolerant, and CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import unique_names

# Separators that the tolerant reader tells apart, in order of preference.
SEPARATORS = [",", "\t", ";", " ", ":"]
OVERFLOW = "_overflow"


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Quoted CSV with a header; a malformed row fails the read.  Types are inferred unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def sniff(header: str) -> str:
    """The separator that the header line has most of; names may hold blanks and colons, so these separate only if the others are absent."""
    for some in (SEPARATORS[:3], SEPARATORS[3:]):
        best = max(some, key=lambda s: (header.count(s), -some.index(s)))
        if best in header:
            return best
    return SEPARATORS[0]


def read_tolerant(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """Unquoted CSV: rows with too many fields are left out, short rows are filled with nulls.

    The separator is told from the header, and equal names are numbered.  Rows
    are read with one spare column; a row that fills it has too many fields.
    Column pruning is off because a pruned read no longer sees such rows.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    header = lines.limit(1).collect()
    if not header:
        raise ValueError(f"no header in {path}")
    first = header[0][0].rstrip("\r")
    separator = sniff(first)
    names, _ = unique_names([n.strip() for n in first.split(separator)])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("sep", separator)
        .option("quote", "")
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        .csv(path)
        .where(F.col(OVERFLOW).isNull())
        .drop(OVERFLOW)
    )
    return inferred(rows) if infer else rows


def inferred(rows: DataFrame) -> DataFrame:
    """String columns cast to long or double where every value allows it; one aggregate decides for all."""
    names = rows.columns
    checks = []
    for k, n in enumerate(names):
        value = F.col(f"`{n}`")
        for kind in ("bigint", "double"):
            checks.append(F.count_if(value.isNotNull() & F.expr(f"try_cast(`{n}` as {kind})").isNull()).alias(f"{kind}{k}"))
        checks.append(F.count(value).alias(f"n{k}"))
    found = rows.agg(*checks).first()
    out = []
    for k, n in enumerate(names):
        kind = None if not found[f"n{k}"] else "bigint" if not found[f"bigint{k}"] else "double" if not found[f"double{k}"] else None
        out.append(F.col(f"`{n}`").cast(kind).alias(n) if kind else F.col(f"`{n}`"))
    return rows.select(*out)


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Strict read; if the file has malformed rows, tolerant read."""
    rows = read_strict(spark, path)
    try:
        rows.select(F.count(F.struct(*[f"`{c}`" for c in rows.columns]))).first()
        return rows
    except Exception as error:
        if "MALFORMED" not in str(error):
            raise
        return read_tolerant(spark, path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; vector, array and map columns are left out."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]
    df.select(*[f"`{c}`" for c in plain]).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
