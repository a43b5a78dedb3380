"""A corpus pipeline: toxicity, quality, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of `documents`.
Classifiers learn from the labels of the documents that reach their stage.

Defined cases: null and empty texts are scored by the classifiers' intercepts,
are copies of each other, and link with nothing as near copies; null ids are
documents of their own and have no labels; of copies the largest id stays, of
near copies the smallest; a row that is there twice stays once; other columns
are carried along up to packing; empty tables give empty results.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionmill.llm import exact_dedup, ngram_join, packing, quality, toxicity
from opinionmill.llm.common import checkpoint_folder, cut, held_out, if_small, table

TOXIC_FROM, GOOD_FROM = 0.7, 0.3


def _labels(spark: SparkSession, sf_dir: str, name: str, modulus: int, remainder: int) -> DataFrame:
    return table(spark, sf_dir, "labels").where(~held_out("doc_id", modulus, remainder)).select("doc_id", F.col(name).alias("label"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 3, 1)), TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir, "quality", 5, 0)), GOOD_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest doc_id."""
    row = [F.struct("doc_id").alias("__key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__sha")]
    decided = exact_dedup.exact_duplicates(docs).select(F.struct("doc_id").alias("__key"), F.col("text_sha256").alias("__sha"), "kept")
    counts = cut(decided.groupBy("__key", "__sha").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"))
    # Only what goes, or is a row of its own twice, is looked up; the other texts stay where they are.
    keyed = docs.select("*", *row)
    single = keyed.join(if_small(counts.select("__key", "__sha")), ["__key", "__sha"], "left_anti")
    twice = keyed.join(if_small(counts.where("kept").select("__key", "__sha")), ["__key", "__sha"], "left_semi").dropDuplicates(["__key", "__sha"])
    return single.unionByName(twice).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard similarity of 0.8 or more."""
    found = ngram_join.near_duplicates(docs, width=5, threshold=(80, 100))
    goes = ~F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = cut(found.groupBy("doc_id").agg(F.bool_and(goes).alias("goes")).where("goes").select("doc_id"))
    # As few documents go, the texts of the others stay where they are; a null id never goes.
    return docs.join(if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: Trained classifiers and tokenizers have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what lies between them goes to the shared checkpoint folder."""
    base = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
