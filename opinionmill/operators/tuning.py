"""Tuning with features that settings share.

All settings of a vectoriser share a fold's features.  For naive Bayes all
vectorisers and smoothings are scored in one plan: documents' term counts are
read once for each fold, a term's row says which vectorisers keep it, weights
and norms are columns of the vectorisers, and log shares are columns of
vectorisers and smoothings.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import idf_of, terms
from .tfidf_stage import Tfidf, term_statistics
from .words import term_counts

# The vectorisers and smoothings that tuning tries.
GRID_FEATURES, GRID_NGRAMS, GRID_MIN_DF, GRID_MAX_DF = [3000, 5000], [1, 2], [2.0, 5.0], [0.8, 0.9]
GRID_ALPHA = [0.1, 0.5, 1.0, 2.0]
SETTING = ["ngrams", "max_features", "min_df", "max_df", "alpha"]


def vectorisers() -> list[tuple[int, int, float, float]]:
    """ngrams, max_features, min_df, max_df of each vectoriser."""
    return list(product(GRID_NGRAMS, GRID_FEATURES, GRID_MIN_DF, GRID_MAX_DF))


def _vocabularies(counts: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """fold, term, idf, in (whether each vectoriser keeps the term): vocabularies of each fold's training documents."""
    folds = sorted(sizes)
    by_fold = [F.sum(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{name}{k}") for k in folds for name, v in (("d", F.lit(1)), ("c", F.col("tf")))]
    stats = counts.groupBy("term").agg(F.count("*").alias("d"), F.sum("tf").alias("c"), *by_fold)
    total = sum(sizes.values())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), (F.col("d") - F.col(f"d{k}")).alias("df"), (F.col("c") - F.col(f"c{k}")).alias("ctf"), F.lit(total - sizes[k]).alias("n")) for k in folds]))
    rows = stats.select("term", each.alias("x")).select("term", "x.*").where(F.col("df") >= min(GRID_MIN_DF))
    # One order serves all: a term's rank under a vectoriser is how many terms up to it pass its bounds.
    order = Window.partitionBy("fold").orderBy(F.desc("ctf"), "term").rowsBetween(Window.unboundedPreceding, 0)
    passes = {(n, low, high): (F.col("df") >= low) & (F.col("df") <= high * F.col("n")) & (F.lit(n > 1) | ~F.col("term").contains(" ")) for n, low, high in product(GRID_NGRAMS, GRID_MIN_DF, GRID_MAX_DF)}
    names = {key: f"p{k}" for k, key in enumerate(passes)}
    ranked = rows.select("*", *[F.when(c, F.sum(F.when(c, 1).otherwise(0)).over(order)).alias(names[key]) for key, c in passes.items()])
    kept = F.array(*[F.coalesce(F.col(names[n, low, high]) <= size, F.lit(False)) for n, size, low, high in vectorisers()])
    return ranked.select("fold", "term", idf_of(F.col("df"), F.col("n")).alias("idf"), kept.alias("in")).where(F.exists("in", lambda x: x))


def naive_bayes_grid(df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label", fold_col: str = "fold", stop_words: Sequence[str] = ()) -> DataFrame:
    """ngrams, max_features, min_df, max_df, alpha, f1 of all settings: the mean over the folds of the weighted F1 on each fold, learnt from the others.

    Rows have an id of their own.  The table is meant for a tuning subset: the
    terms of a fold are ranked by one task.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.col(fold_col).cast("int").alias("fold"))
    marks = docs.select("id", "label", "fold").persist()
    sizes = {r["fold"]: r["count"] for r in marks.groupBy("fold").count().collect()}
    counts = term_counts(terms(docs, "id", "text", (1, max(GRID_NGRAMS)), list(stop_words)), "id", "terms").join(marks, "id").persist()
    vocabulary = _vocabularies(counts, sizes).persist()
    settings, v = list(product(vectorisers(), GRID_ALPHA)), len(vectorisers())
    # A document's weights under each fold's vocabulary; `home` is the fold that it is scored in.
    held = vocabulary.withColumnRenamed("fold", "k")
    weights = counts.withColumnRenamed("fold", "home").join(held, "term").select("id", "label", "home", "k", "term", "in", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = weights.groupBy("id", "k").agg(F.array(*[F.sqrt(F.sum(F.when(F.col("in")[s], F.col("w") * F.col("w")))) for s in range(v)]).alias("norm"))
    unit = weights.join(norms, ["id", "k"]).select("id", "label", "home", "k", "term", F.transform("in", lambda x, s: F.when(x, F.col("w") / F.col("norm")[s]).otherwise(0.0)).alias("u")).persist()
    sums = unit.where("home != k").groupBy("k", "term", "label").agg(F.array(*[F.sum(F.col("u")[s]) for s in range(v)]).alias("s"))
    learnt = marks.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(k,) for k in sizes], "k int"))).where("fold != k")
    classes = learnt.groupBy("k", "label").agg(F.count("*").alias("n"))
    classes = classes.select("k", "label", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("k"))).alias("prior"))
    size = held.groupBy("k").agg(F.array(*[F.count_if(F.col("in")[s]) for s in range(v)]).alias("size"))
    totals = sums.groupBy("k", "label").agg(F.array(*[F.sum(F.col("s")[s]) for s in range(v)]).alias("total"))
    zero = F.array(*[F.lit(0.0)] * v)
    room = classes.join(size, "k").join(totals, ["k", "label"], "left").select("k", "label", "prior", "size", F.coalesce("total", zero).alias("total"))
    dense = held.select("k", "term").join(F.broadcast(room), "k").join(sums, ["k", "term", "label"], "left").withColumn("s", F.coalesce("s", zero))
    share = [F.log(F.col("s")[s] + a) - F.log(F.col("total")[s] + a * F.col("size")[s]) for s in range(v) for a in GRID_ALPHA]
    dense = dense.select("k", "term", F.col("label").alias("class"), F.array(*share).alias("lp"))
    n_alpha = len(GRID_ALPHA)
    gained = unit.where("home = k").select("id", "k", "term", "u").join(dense, ["k", "term"]).groupBy("id", "class").agg(F.array(*[F.sum(F.col("u")[i // n_alpha] * F.col("lp")[i]) for i in range(len(settings))]).alias("gain"))
    grid = marks.join(F.broadcast(classes.select(F.col("k").alias("fold"), F.col("label").alias("class"), "prior")), "fold")
    scored = grid.join(gained, ["id", "class"], "left").select("id", "fold", "label", "class", "prior", F.posexplode(F.coalesce("gain", F.array(*[F.lit(0.0)] * len(settings)))).alias("setting", "gain"))
    score = F.round(F.col("prior") + F.col("gain"), 9)
    predicted = scored.groupBy("id", "fold", "label", "setting").agg(F.min_by("class", F.struct((-score).alias("s"), "class")).alias("prediction"))
    cells = predicted.groupBy("fold", "setting", "label", "prediction").agg(F.count("*").alias("n"))
    roles = F.array(
        F.struct(F.col("label").alias("class"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
    )
    by_class = cells.select("fold", "setting", F.explode(roles).alias("x")).groupBy("fold", "setting", "x.class").agg(*[F.sum(f"x.{c}").alias(c) for c in ("tp", "t", "p")])
    by_fold = by_class.groupBy("fold", "setting").agg((F.sum(F.col("t") * 2 * F.col("tp") / (F.col("t") + F.col("p"))) / F.sum("t")).alias("f1"))
    found = by_fold.groupBy("setting").agg(F.avg("f1").alias("f1"))
    names = df.sparkSession.createDataFrame([(k, *s, a) for k, (s, a) in enumerate(settings)], "setting int, ngrams int, max_features int, min_df double, max_df double, alpha double")
    return names.join(found, "setting").select(*SETTING, "f1")


def shared_search(
    folded: DataFrame, stages: Sequence, counter: Tfidf, ngrams: dict[int, Sequence], classifier: Estimator, maps: Sequence[dict], folds: int, parallelism: int = 2
) -> list[tuple[float, dict, tuple[int, int, float, float]]]:
    """(mean weighted F1, classifier's parameters, vectoriser) of every setting.

    `ngrams` has the stages that make each range's terms, from rows with a
    label index and a fold; a fold's vectors are made once for each vectoriser
    and shared by all of the classifier's parameter maps, which are fitted side
    by side.
    """
    judge = MulticlassClassificationEvaluator(labelCol="label_index", predictionCol="prediction", metricName="f1")
    scores: dict[tuple, list[float]] = {}
    for n, makers in ngrams.items():
        rows = folded
        for stage in [*stages, *makers]:
            rows = stage.transform(rows)
        rows = rows.persist()
        for k in range(folds):
            training = rows.where(F.col("fold") != k)
            statistics, n_docs = term_statistics(training, counter.getInputCol()).persist(), training.count()
            for which in (x for x in vectorisers() if x[0] == n):
                size, low, high = which[1:]
                model = counter.copy({counter.vocabSize: size, counter.minDF: low, counter.maxDF: high}).from_statistics(statistics, n_docs)
                vectors = model.transform(rows).select("label_index", "weight", "features", "fold").persist()
                held = vectors.where(F.col("fold") == k)
                fits = classifier.fitMultiple(vectors.where(F.col("fold") != k), list(maps))
                with ThreadPoolExecutor(parallelism) as pool:
                    for index, score in pool.map(lambda _: (lambda i, m: (i, judge.evaluate(m.transform(held))))(*next(fits)), range(len(maps))):
                        scores.setdefault((index, which), []).append(score)
                vectors.unpersist()
            statistics.unpersist()
        rows.unpersist()
    return [(sum(found) / len(found), maps[index], which) for (index, which), found in scores.items()]
