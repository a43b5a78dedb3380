"""File listings and bounded reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_size
from ..operators.split import hash_share
from .csv import write_csv


def list_files(spark: SparkSession, folder: str, extension: str = "csv", min_bytes: int = 0) -> DataFrame:
    """path, length, modificationTime of a folder's files, sorted by path; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).load(folder)
    return found.select("path", "length", "modificationTime").where(F.col("length") >= min_bytes).orderBy("path")


def largest_file(spark: SparkSession, folder: str, extension: str = "csv", over_mb: float = 50) -> DataFrame:
    """The largest file over a size, if there is one."""
    return list_files(spark, folder, extension, int(over_mb * 1024**2)).orderBy(F.desc("length"), "path").limit(1)


def inventory(spark: SparkSession, folder: str, extension: str = "csv") -> DataFrame:
    """name, path, length, size, extension, modified, n_rows, n_columns of every CSV file.

    n_columns counts the header's fields, quoted commas aside; the header is
    the line where the file begins.
    """
    files = list_files(spark, folder, extension)
    fields = F.size(F.split(F.regexp_replace("value", '"[^"]*"', ""), ","))
    lines = (
        spark.read.option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", True).text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
        # Within a partition rows are numbered in the order of their files' lines.
        .withColumn("nth", F.monotonically_increasing_id())
        .groupBy("path", "start")
        .agg(F.count("*").alias("n"), F.min(F.struct("nth", fields.alias("fields")))["fields"].alias("fields"))
        .groupBy("path")
        .agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("n_rows"), F.min(F.struct("start", "fields"))["fields"].alias("n_columns"))
    )
    plain = F.regexp_replace("path", "^file:/+", "/")
    return (
        files.withColumn("__p", plain)
        .join(lines.select(plain.alias("__p"), "n_rows", "n_columns"), "__p", "left")
        .select(
            F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", human_size(F.col("length")).alias("size"),
            F.lit(f".{extension}").alias("extension"), F.col("modificationTime").alias("modified"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_columns",
        )
    )


def head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def rows_between(df: DataFrame, order_col: str, skip: int, n: int) -> DataFrame:
    """n rows after the first `skip` in the order of a column."""
    return df.orderBy(order_col).offset(skip).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About n rows, each kept with the same probability."""
    total = df.count()
    return df.sample(min(1.0, n / total) if total else 1.0, seed)


def write_sample(df: DataFrame, path: str, id_col: str, n: int = 1000, seed: int = 42) -> None:
    """About n rows as CSV, each kept with the same probability by its id's hash, so that the same rows are taken again."""
    total = df.count()
    write_csv(df.where(hash_share(id_col, seed) < (n / total if total else 1.0)), path)
