"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; only a local session may leave it unset and gets a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


#: Rows that `if_small` broadcasts at most, some megabytes of ids and hashes, and bytes of what they hold beside these.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def if_small(rows: DataFrame, width: Column | None = None) -> DataFrame:
    """For a join: few rows, counted first, are broadcast, so that the other side isn't moved; else both are shuffled.

    `width`: bytes of a row's texts, of rows that have any; they are added up
    with the count.  The hint keeps Spark, which may size rows too low, from
    broadcasting what was found to be large.
    """
    n, size = rows.agg(F.count("*"), F.sum(F.lit(0) if width is None else width)).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else rows.hint("merge")


def held_out(id_col: str, modulus: int, remainder: int) -> F.Column:
    """True where crc32 of the id's decimal text falls in the held-out remainder."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


#: Partitions of a sample, whose rows are bounded.
SAMPLE_PARTS = 24


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `rows` labelled texts, picked by a hash of their id label by label: columns text, label.

    Every label gets an equal share; what a rare one leaves goes to the others.
    Only ids that `docs` has count; an id with several rows gives the text with
    the smallest hash, one with several labels the smallest label; null labels
    and ids are left out.  More labels than `rows` are an error.  The picked
    labels are at most `rows`, so they are broadcast and the texts aren't moved.
    """
    ids = docs.select(F.col(id_col).alias("__id")).where(F.col("__id").isNotNull()).distinct()
    known = labels.where(F.col("label").isNotNull()).select(F.col(id_col).alias("__id"), "label").groupBy("__id").agg(F.min("label").alias("label"))
    known = cut(known.join(ids, "__id", "left_semi").withColumn("__hash", F.xxhash64("__id", F.lit(7))))
    # Only the first parts of the hash range that hold `rows` rows of a label are ranked, so that no label is one task.
    part = F.shiftright("__hash", 48)
    counts = known.groupBy("label", part.alias("__part")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("label").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("ahead") < rows).groupBy("label").agg(F.max("__part").alias("__last"))
    found = lasts.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"more labels than the {rows} rows to learn from")
    near = known.join(F.broadcast(docs.sparkSession.createDataFrame(found, lasts.schema)), "label").where(part <= F.col("__last"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("__hash", "__id"))
    picked = near.withColumn("__rank", rank).orderBy("__rank", "__hash", "__id", "label").limit(rows).select("__id", "label")
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "__id")
    first = texts.groupBy("__id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    return cut(first.select("text", "label").repartition(SAMPLE_PARTS))
