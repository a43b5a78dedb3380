"""The TF-IDF stage, squared hinge loss and tuning against plain computations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from opinionmill.operators import features, ml, svm, tfidf_stage, tuning
from opinionmill.operators.split import folds
from opinionmill.sources import registry

TEXTS = [(i, " ".join(f"w{(i * k) % 11}" if k % 3 else "red blue" for k in range(1, 4 + i % 6)) + (" odd" if i == 4 else ""), ["a", "b"][i % 2]) for i in range(40)] + [(40, "", "a"), (41, "zzz", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, text string, label string")


def listed(model, rows):
    names, column = model.stages[-1].vocabulary, {}
    for r in model.transform(rows).collect():
        for at, w in zip(r["features"].indices, r["features"].values):
            column[r["id"], names[at]] = w
    return column


@pytest.mark.parametrize("low, high, size, use_idf", [(2, 0.8, 5000, True), (1, 1.0, 7, True), (5, 0.6, 20, False)])
def test_stage_equals_the_long_form(docs, low, high, size, use_idf):
    rows = docs.withColumnRenamed("text", "processed_text")
    stages = ml.feature_stages(size, (1, 2), low, high)
    stages[-1].set(stages[-1].useIdf, use_idf)
    found = listed(Pipeline(stages=stages).fit(rows), rows)
    want, vocabulary = features.fit_transform_tfidf(docs, "id", "text", size, (1, 2), use_idf, low, high, stop_words=[])
    want = {(r["id"], r["term"]): r["weight"] for r in want.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert vocabulary.count() <= size


def test_stage_is_saved_and_loaded(docs, tmp_path):
    rows = docs.withColumnRenamed("text", "processed_text")
    model = Pipeline(stages=ml.feature_stages(30, (1, 1), 2)).fit(rows)
    model.write().save(str(tmp_path / "model"))
    assert listed(PipelineModel.load(str(tmp_path / "model")), rows) == listed(model, rows)
    with pytest.raises(ValueError, match="no terms"):
        Pipeline(stages=ml.feature_stages(30, (1, 1), 1000)).fit(rows)


def dense_optimum(x, y, w, penalty):
    """Newton's method with the whole Hessian, the intercept a weight like the others."""
    x = np.hstack([x, np.ones((len(x), 1))])
    theta = np.zeros(x.shape[1])
    for _ in range(200):
        short = np.maximum(0, 1 - y * (x @ theta))
        gradient = -2 * x.T @ (w * y * short) / w.sum() + penalty * theta
        active = (short > 0) * w
        step = np.linalg.solve(2 * (x.T * active) @ x / w.sum() + penalty * np.eye(len(theta)), gradient)
        value = lambda t: (w * np.maximum(0, 1 - y * (x @ t)) ** 2).sum() / w.sum() + penalty / 2 * t @ t
        size = 1.0
        while value(theta - size * step) > value(theta) and size > 1e-9:
            size /= 2
        theta = theta - size * step
    return theta


@pytest.mark.parametrize("classes, parts", [(2, 1), (3, 4)])
def test_squared_hinge_optimum(spark, monkeypatch, classes, parts):
    """Partitions beyond TREE_FROM add up in a tree; vectors are sparse and dense."""
    monkeypatch.setattr(svm, "TREE_FROM", 3)
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 6)) * (r.random((120, 6)) < 0.6)
    label = (np.abs(x[:, 0] * 2 + x[:, 1] + r.normal(size=120)) % classes).astype(int)
    w = r.integers(1, 4, 120).astype(float)
    rows = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(6, [(k, float(v[k])) for k in np.flatnonzero(v)]), float(c), float(b)) for i, (v, c, b) in enumerate(zip(x, label, w))]
    df = spark.createDataFrame(rows, ["id", "features", "label", "weight"]).repartition(parts)
    penalty = 0.02
    model = svm.SupportVectors(weightCol="weight", regParam=penalty, tol=1e-9).fit(df)
    found = np.hstack([np.array(model.getOrDefault("weights")), np.array(model.getOrDefault("intercepts"))[:, None]])
    for k, mine in enumerate(found):
        own = 1 if classes == 2 else k
        assert mine == pytest.approx(dense_optimum(x, np.where(label == own, 1.0, -1.0), w, penalty), abs=1e-5)
    scored = {r["id"]: r for r in model.transform(df).collect()}
    margins = np.hstack([x, np.ones((120, 1))]) @ found.T
    margins = np.hstack([-margins, margins]) if classes == 2 else margins
    assert all(scored[i]["rawPrediction"].toArray() == pytest.approx(margins[i]) and scored[i]["prediction"] == margins[i].argmax() for i in range(120))


def test_saved_pipeline_scores_alike(spark, docs, tmp_path):
    trained = ml.train(docs, "text", "label", "id", ml.SVM, max_features=30, min_df=1.0)
    models = registry.Registry(spark, str(tmp_path / "models"))
    models.save_pipeline("svm", trained.model, {"accuracy": 1.0})
    loaded, values, _ = models.load("svm")
    again = ml.Trained(loaded, trained.labels, trained.vocabulary, trained.train, trained.test, trained.name)
    score = lambda t: sorted(map(str, ml.batch_predict(t, docs, "text").select("id", "predicted_sentiment", "confidence").collect()))
    assert score(again) == score(trained) and values == {"accuracy": 1.0}


def test_shared_search_tries_every_setting(docs, monkeypatch):
    for name, value in (("GRID_FEATURES", [10, 20]), ("GRID_NGRAMS", [1, 2]), ("GRID_MIN_DF", [1.0]), ("GRID_MAX_DF", [0.9])):
        monkeypatch.setattr(tuning, name, value)
        monkeypatch.setattr(ml, name, value)
    monkeypatch.setattr(ml, "GRID_C_SVM", [0.1, 1.0])
    trained = ml.train(docs, "text", "label", "id", ml.SVM, tune=True, cv=2, parallelism=3)
    assert len(trained.tried) == 4 * 2 * 2 and trained.tried[0]["f1"] == max(t["f1"] for t in trained.tried)
    # A setting's score is what its own pipeline gives on each fold.
    one = trained.tried[-1]
    rows = folds(trained.train.select("id", "label", "processed_text", "weight"), "id", "label", 2, 42)
    f1 = []
    for k in range(2):
        stages = ml.feature_stages(one["max_features"], (1, one["ngrams"]), one["min_df"], one["max_df"])
        index = ml.StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc")
        svc = svm.SupportVectors(labelCol="label_index", weightCol="weight", maxIter=2000).copy({})
        for p, v in one["parameters"].items():
            svc._set(**{p.name: v})
        model = Pipeline(stages=[index, *stages, svc]).fit(rows.where(F.col("fold") != k))
        judge = ml.MulticlassClassificationEvaluator(labelCol="label_index", metricName="f1")
        f1.append(judge.evaluate(model.transform(rows.where(F.col("fold") == k))))
    assert one["f1"] == pytest.approx(np.mean(f1))


def test_statistics_count_documents_and_occurrences(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],), (None,)], "t array<string>")
    assert sorted(map(tuple, tfidf_stage.term_statistics(df, "t").collect())) == [("a", 2, 3), ("b", 1, 1)]


def test_batches_larger_than_a_block_are_packed_whole():
    n = 9000
    values = pa.array([[float(k), 1.0] for k in range(n)])
    x = pa.StructArray.from_arrays([pa.array([0] * n, pa.int8()), pa.array([3] * n, pa.int32()), pa.array([[0, k % 2 + 1] for k in range(n)], pa.list_(pa.int32())), values], names=["type", "size", "indices", "values"])
    batch = pa.RecordBatch.from_arrays([x, pa.array(np.arange(n) % 2.0), pa.array(np.ones(n))], names=["x", "y", "w"])
    blocks = [svm._Block(b.to_pylist()[0]) for b in svm._packed(iter([batch]))]
    assert len(blocks) > 1 and np.array_equal(np.concatenate([b.y for b in blocks]), np.arange(n) % 2.0)
    theta = np.array([[1.0], [10.0], [100.0], [0.5]])
    assert np.allclose(np.concatenate([b.times(theta) for b in blocks])[:, 0], [k + 10.0 ** (k % 2 + 1) + 0.5 for k in range(n)])
