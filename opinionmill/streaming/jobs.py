"""Structured Streaming forms of scoring and of counting for naive Bayes.

Both run on any stream of reviews; `availableNow` reads what is there and ends.
Micro-batches write into a folder of their own number, so that a batch that is
run again after a failure overwrites what it had left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import normalise
from ..operators import naive_bayes as NB
from ..operators.features import hashed
from ..operators.ranking import order_key
from ..operators.split import hash_split


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply `work` to every micro-batch and write its result under out/batch=N."""

    def step(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def score_stream(stream: DataFrame, model: NB.NaiveBayes, id_col: str, text_col: str, out: str, checkpoint: str, features: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """id, prediction, confidence of every review, as the batch form gives them."""
    spread = features or (lambda df: hashed(df, id_col, text_col, by_term=True))

    def work(batch: DataFrame) -> DataFrame:
        return NB.predict(model, batch.select(F.col(id_col).alias("id")), spread(batch)).drop("probabilities")

    run_batches(stream, work, out, checkpoint)


def count_stream(stream: DataFrame, id_col: str, text_col: str, label_col: str, out: str, checkpoint: str) -> None:
    """kind, label, term, value of every micro-batch: class counts and term weights that add up to a model."""

    def work(batch: DataFrame) -> DataFrame:
        return _counts(batch.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), normalise(F.col(label_col)).alias("label")))

    run_batches(stream, work, out, checkpoint)


def _counts(rows: DataFrame) -> DataFrame:
    """kind, label, term, value of rows id, text, label."""
    counts = NB.class_counts(rows).select(F.lit("class").alias("kind"), "label", F.lit(None).cast("string").alias("term"), F.col("n").cast("double").alias("value"))
    sums = NB.term_sums(hashed(rows, "id", "text", by_term=True, keep=["label"]))
    return counts.unionByName(sums.select(F.lit("term").alias("kind"), "label", "term", F.col("w").alias("value")))


def train_and_hold_out(
    stream: DataFrame, id_col: str, text_col: str, label_col: str, out: str, checkpoint: str, test_size: float = 0.2, cap: int = 10_000, seed: int = 42
) -> None:
    """Counts of the training rows as count_stream writes them, under out/counts, and a bounded set of evaluation rows, under out/held.

    A row's side follows from its id's hash.  The evaluation set is the `cap`
    held-out rows that come first in the hash's order, whatever the
    micro-batches are: each batch merges its own first rows with the set that
    the batch before it left, and writes the result under its own number, so a
    batch that is run again gives the same set.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = hash_split(batch.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), normalise(F.col(label_col)).alias("label")), "id", test_size, seed).persist()
        _counts(rows.where(~F.col("is_test"))).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        held = rows.where("is_test").select("id", "text", "label", order_key("id", seed).alias("key"))
        if number:
            held = held.unionByName(batch.sparkSession.read.schema(held.schema).parquet(f"{out}/held/batch={number - 1}"))
        held.orderBy("key", "id").limit(cap).write.mode("overwrite").parquet(f"{out}/held/batch={number}")
        rows.unpersist()

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def held_out_rows(spark: SparkSession, out: str) -> DataFrame:
    """id, text, label of the evaluation set after the last micro-batch."""
    found = spark.read.parquet(f"{out}/held")
    last = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == last).select("id", "text", "label")


def evaluate_held_out(spark: SparkSession, out: str, alpha: float = 1.5, n_features: int = 1 << 18) -> DataFrame:
    """id, label, prediction of the evaluation set under the model of all training rows so far."""
    rows = held_out_rows(spark, out)
    model = model_of_deltas(spark, f"{out}/counts", alpha, n_features)
    return NB.predict(model, rows, hashed(rows, "id", "text", by_term=True)).join(rows.select("id", "label"), "id").select("id", "label", "prediction")


def model_of_deltas(spark: SparkSession, out: str, alpha: float = 1.5, n_features: int = 1 << 18) -> NB.NaiveBayes:
    """The model of all micro-batches so far."""
    rows = spark.read.parquet(out).groupBy("kind", "label", "term").agg(F.sum("value").alias("value"))
    counts = rows.where("kind = 'class'").select("label", F.col("value").cast("long").alias("n"))
    return NB.from_counts(counts, rows.where("kind = 'term'").select("label", "term", F.col("value").alias("w")), alpha, n_features)


def running_classes(stream: DataFrame, label_col: str, name: str, checkpoint: str) -> DataFrame:
    """label, n after everything that is there; the state holds one row a class, so no watermark is needed."""
    counts = stream.groupBy(normalise(F.col(label_col)).alias("label")).agg(F.count("*").alias("n"))
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
