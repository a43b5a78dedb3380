"""Strict CSV with quoted line breaks, read by many tasks.

A quoted field may hold line breaks, so a line of a file range may lie inside a
record that began in an earlier range.  Whether it does follows from the number
of quotes ahead of it: the ranges' quotes are counted first, and a prefix sum of
their parities tells for each range whether it begins inside a record.  Tasks
then put their lines together to records; what is open at a range's end and
what closes an open record at another's beginning meet in one small shuffle.

Quotes only delimit fields (a quote inside a field is doubled); lines end with
a line feed, before which a carriage return is dropped at a record's end.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import unique_names
from ..session import stored

QUOTE = '"'
_SCHEMA = "path string, start long, nth long, record string, first boolean, kind string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _openings(spark: SparkSession, path: str) -> DataFrame:
    """path, start, inside of each file range: whether it begins inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    ranges = _lines(spark, path).groupBy("path", "start").agg(F.sum(quotes).alias("quotes"))
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("path", "start", (F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2 == 1).alias("inside"))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range, and its open ends: `head` closes (or continues) a record of an earlier range, `tail` opens one."""
    key, held, inside, nth, at_head = None, [], False, 0, False

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["path", "start", "nth", "record", "first", "kind"])

    def close() -> list[tuple]:
        """What is left when a range ends."""
        if key is None or not held:
            return []
        # A range wholly inside one field continues it.
        return [(*key, nth, "\n".join(held), False, "through" if at_head else "tail")]

    for batch in batches:
        values, paths, starts = batch.column(0), batch.column(1), np.asarray(batch.column(2))
        opens = np.asarray(batch.column(3).cast(pa.uint8()))
        odd = np.asarray(pc.count_substring(values, QUOTE)) % 2 == 1
        lines, names, rows = values.to_pylist(), paths.to_pylist(), []
        for k, line in enumerate(lines):
            if key != (names[k], starts[k]):
                rows += close()
                key, held, nth = (names[k], int(starts[k])), [], 0
                inside = at_head = bool(opens[k])
            if not inside and not odd[k]:
                rows.append((*key, nth, line, key[1] == 0 and nth == 0, "record"))
                nth += 1
                continue
            held.append(line)
            if odd[k]:
                inside = not inside
            if not inside:
                rows.append((*key, nth, "\n".join(held), key[1] == 0 and nth == 0 and not at_head, "head" if at_head else "record"))
                held, at_head, nth = [], False, nth + 1
        if rows:
            yield out(rows)
    if rows := close():
        yield out(rows)


def records(spark: SparkSession, path: str) -> DataFrame:
    """record, first (whether it is its file's first one): the CSV records of one or more files, without blank lines."""
    # One row a file range, looked up by every task.
    marked = _lines(spark, path).join(F.broadcast(_openings(spark, path)), ["path", "start"]).select("value", "path", "start", "inside")
    found = marked.mapInArrow(_assembled, _SCHEMA)
    whole = found.where("kind = 'record'").select("record", "first")
    # The parts of a record that crosses range edges follow each other from a tail on: it is the tail's, by a count of tails.
    ends = found.where("kind <> 'record'")
    order = Window.partitionBy("path").orderBy("start", "nth")
    numbered = ends.withColumn("number", F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order))
    joined = numbered.groupBy("path", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "nth", "record"))), lambda x: x["record"]), "\n").alias("record"),
        (F.min("start") == 0).alias("first_range"), F.min(F.struct("start", "nth"))["nth"].alias("nth"),
    )
    crossing = joined.select("record", (F.col("first_range") & (F.col("nth") == 0)).alias("first"))
    return whole.unionByName(crossing).select(F.regexp_replace("record", "\r$", "").alias("record"), "first").where(F.col("record") != "")


def _inferred(rows: DataFrame) -> list[str | None]:
    """For each column the narrowest type that all its values have, by one aggregate; null: text."""
    kinds = ["int", "bigint", "double", "boolean"]
    checks = []
    for k, name in enumerate(rows.columns):
        value = F.col(f"`{name}`")
        plain = ~value.rlike(r"^\s|\s$")
        checks += [F.count(value).alias(f"n{k}")] + [F.count_if(value.isNotNull() & ~(plain & F.expr(f"try_cast(`{name}` as {kind})").isNotNull())).alias(f"{kind}{k}") for kind in kinds[:3]]
        checks.append(F.count_if(value.isNotNull() & ~F.lower(value).isin("true", "false")).alias(f"boolean{k}"))
    found = rows.agg(*checks).first()
    return [next((kind for kind in kinds if found[f"n{k}"] and not found[f"{kind}{k}"]), None) for k in range(len(rows.columns))]


def read_strict_split(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Quoted CSV with a header in each file, like `csv.read_strict`, but large files are read by many tasks.

    A malformed row fails the read.  Without a schema, whole numbers, doubles
    and booleans are told from the values, all others are text.
    """
    # Written once: header, types and values are told from the records, not from the lines again.
    found = stored(records(spark, path), "records")
    header = found.where("first").select("record").limit(1).collect()
    if not header:
        raise ValueError(f"no header in {path}")
    options = {"escape": QUOTE, "mode": "FAILFAST", "multiLine": "true", "lineSep": "\n"}
    names = next(csv.reader(io.StringIO(header[0][0], newline="")))
    if schema is None:
        plain = T.StructType([T.StructField(n, T.StringType()) for n in unique_names(names)[0]])
    else:
        plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = found.where("not first").select(F.from_csv("record", F.lit(plain.toDDL()), options).alias("r")).select("r.*")
    if schema is not None:
        return rows
    kinds = _inferred(rows)
    return rows.select(*[F.col(f"`{n}`").cast(kind).alias(n) if kind else F.col(f"`{n}`") for n, kind in zip(plain.names, kinds)])
