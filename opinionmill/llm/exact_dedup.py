"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a text is the value of its bytes, taken as coefficients, at
two fixed points modulo two primes.  It composes: the fingerprint of a whole is
the sum of its chunks' fingerprints, each shifted by the power of the base that
belongs to the bytes behind the chunk.  Long texts are therefore cut into
chunks that different tasks hash, and the shifted terms are added up by a
plain aggregate.  Texts that share fingerprint and length are then compared
chunk by chunk with their group's representative in a streaming join, so the
result is exact; should a comparison fail, the texts concerned are grouped by
their own content.

Defined cases: null text is empty, and empty texts equal each other; a null id
is kept as a row (it stays only where its whole group has null ids); repeated
rows count as documents each and share one decision; an empty table gives an
empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, if_small
from .textbatch import slices

#: Bytes of a chunk, rows of a group that are compared with one copy of its head.
CHUNK_BYTES, SALT_ROWS = 1 << 16, 2000
#: Moduli and evaluation points of the two lanes.
LANES = ((2147483647, 1103515245), (2147483629, 69069069))


def chunk_terms(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lanes=LANES) -> list[np.ndarray]:
    """Fingerprint of each chunk of `data`, a lane each; chunks lie side by side and none is empty."""
    lengths = stops - starts
    exponent = np.repeat(stops, lengths) - 1 - np.arange(starts[0], stops[-1])
    values = data[starts[0] : stops[-1]].astype(np.int64) + 1
    return [np.add.reduceat(values * _powers(p, b)[exponent], starts - starts[0]) % p for p, b in lanes]


_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(prime: int, base: int) -> np.ndarray:
    if (prime, base) not in _tables:
        out, x = np.empty(CHUNK_BYTES, dtype=np.int64), 1
        for k in range(CHUNK_BYTES):
            out[k], x = x, x * base % prime
        _tables[prime, base] = out
    return _tables[prime, base]


def _hash_chunks(chunks: DataFrame, lanes) -> DataFrame:
    """Adds lane_0, lane_1: each chunk's fingerprint shifted by the bytes behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, at, column = (batch.column(i) for i in (2, 3, 4))
            behind = np.asarray(total) - np.asarray(at) * CHUNK_BYTES
            shifted = [np.zeros(len(batch), dtype=np.int64) for _ in lanes]
            for first, stop, data, offsets in slices(column):
                lengths = np.diff(offsets)
                some = np.flatnonzero(lengths)
                if not len(some):
                    continue
                for out, term, (p, b) in zip(shifted, chunk_terms(data, offsets[:-1][some], offsets[1:][some], lanes), lanes):
                    out[first + some] = term
                    for k in first + some[behind[first + some] > lengths[some]]:
                        out[k] = int(out[k]) * pow(b, int(behind[k] - lengths[k - first]), p) % p
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *map(pa.array, shifted)], names=[*batch.schema.names[:4], "lane_0", "lane_1"])

    kind = chunks.schema["__id"].dataType.simpleString()
    return chunks.mapInArrow(run, f"__id {kind}, sha string, n_bytes long, chunk int, lane_0 long, lane_1 long")


def _chunks(rows: DataFrame) -> DataFrame:
    """One row for each chunk of each text; an empty text has one empty chunk."""
    return rows.select(
        *[c for c in rows.columns if c != "raw"],
        F.posexplode(
            F.when(F.col("n_bytes") <= CHUNK_BYTES, F.array("raw")).otherwise(
                F.expr(f"transform(sequence(0L, (n_bytes - 1) div {CHUNK_BYTES}L), k -> substring(raw, cast(k * {CHUNK_BYTES} + 1 as int), {CHUNK_BYTES}))")
            )
        ).alias("chunk", "bytes"),
    )


def _rows(df: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column]) -> DataFrame:
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(F.col(id_col).alias("__id"), text.alias("text")).select(
        "__id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("raw")
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = lambda c: c, lanes=LANES) -> DataFrame:
    """One row for each input row: __id, sha, n_bytes, lane_0, lane_1."""
    rows = _rows(df, id_col, text_col, normalise)
    short = _hash_chunks(_chunks(rows.where(F.col("n_bytes") <= CHUNK_BYTES)), lanes).drop("chunk")
    # Long texts: their chunks are dealt out, hashed apart and added up.
    long = _hash_chunks(_chunks(rows.where(F.col("n_bytes") > CHUNK_BYTES)).repartition("__id", "sha", "chunk"), lanes)
    whole = (
        long.groupBy("__id", "sha", "n_bytes", "chunk")
        .agg(F.first("lane_0").alias("lane_0"), F.first("lane_1").alias("lane_1"), F.count("*").alias("copies"))
        .groupBy("__id", "sha", "n_bytes")
        .agg(*[(F.sum(f"lane_{k}") % lanes[k][0]).alias(f"lane_{k}") for k in (0, 1)], F.max("copies").alias("copies"))
        .select("__id", "sha", "n_bytes", "lane_0", "lane_1", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
        .drop("copy")
    )
    return short.unionByName(whole)


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
    lanes=LANES,
) -> DataFrame:
    """One row for each input row: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.  `normalise` maps the
    text column before anything else.
    """
    key = ["lane_0", "lane_1", "n_bytes"]
    # As a struct, a null id equals a null id in joins.
    prints = cut(fingerprints(df, id_col, text_col, normalise, lanes).withColumn("__key", F.struct("__id")))
    groups = prints.groupBy(*key).agg(F.max(F.struct("__key", "sha")).alias("head"), F.max("__id").alias("keep_id"), F.count("*").alias("n"))
    shared = cut(groups.where("n > 1"))
    # Chunkwise comparison of every text in a shared group with the group's head; other texts aren't moved.
    heads = shared.select(*key, "head", F.ceil(F.col("n") / SALT_ROWS).alias("salts"))
    members = cut(prints.select("__key", "sha", *key).join(if_small(heads), key).distinct())
    texts = _rows(df, id_col, text_col, normalise).drop("n_bytes").withColumn("__key", F.struct("__id")).join(if_small(members), ["__key", "sha"])
    chunks = _chunks(texts).withColumn("is_head", (F.col("__key") == F.col("head.__key")) & (F.col("sha") == F.col("head.sha")))
    # A head goes to every salt of its group.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    head_chunks = chunks.where("is_head").select(*key, "chunk", F.col("bytes").alias("head_bytes"), every)
    rest = chunks.where("not is_head").withColumn("salt", F.pmod(F.xxhash64("__key", "sha"), "salts"))
    same = rest.join(head_chunks, [*key, "chunk", "salt"]).where(F.col("bytes") != F.col("head_bytes"))
    differing = cut(same.select("__key", "sha").distinct())
    sizes, names = shared.select(*key, "keep_id", "n"), key
    if not differing.isEmpty():
        # Unequal despite equal fingerprints: grouped by content.
        bad = texts.join(if_small(differing), ["__key", "sha"], "left_semi").select("__key", "sha", *key, "raw").distinct()
        own = bad.groupBy(*key, "raw").agg(F.max(F.struct("__key", "sha"))["sha"].alias("variant"))
        variants = cut(bad.join(own, [*key, "raw"]).select("__key", "sha", "variant"))
        prints = cut(prints.join(variants, ["__key", "sha"], "left").withColumn("variant", F.coalesce("variant", F.lit(""))))
        names = [*key, "variant"]
        sizes = cut(prints.groupBy(*names).agg(F.max("__id").alias("keep_id"), F.count("*").alias("n")).where("n > 1"))
    found = prints.join(if_small(sizes), names, "left")
    keep = F.when(F.col("n").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("__id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("__id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256")
    )
