import pytest
from pyspark.sql import functions as F

from opinionmill.operators import columns, features, metrics, ml, naive_bayes, profile, split
from opinionmill.sources import csv, files, registry

SEPARABLE = [(i, f"{['great', 'awful', 'plain'][i % 3]} shared words number {['a', 'b', 'c', 'd'][i % 4]}{i % 7}", ["positive", "negative", "neutral"][i % 3]) for i in range(300)]


@pytest.fixture(scope="module")
def separable(spark):
    return spark.createDataFrame(SEPARABLE, "id long, text string, label string")


def test_unique_names():
    assert columns.unique_names(["Id", "Id", "Value"])[0] == ["Id", "Id_1", "Value"]
    assert columns.unique_names(["x", "x_1", "x"])[0] == ["x", "x_1", "x_2"]
    assert columns.unique_names([]) == ([], {})


def test_detection(spark):
    long = "a text that is longer than twenty characters"
    for names, types, row, want in [
        (("review_text", "sentiment"), "string, int", (long, 1), ("review_text", "sentiment")),
        (("comment_content", "rating"), "string, int", (long, 1), ("comment_content", "rating")),
        (("col1", "col2"), "string, int", (long, 1), ("col1", "col2")),
        (("comment", "label"), "string, int", (long, 1), ("comment", "label")),
    ]:
        df = spark.createDataFrame([row], ", ".join(f"{n} {t}" for n, t in zip(names, types.split(", "))))
        for variant in ("full", "chunk"):
            assert columns.detect_columns(df, variant) == want


def test_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(x,) for x in ["positive"] * 4 + ["negative"] * 2 + ["neutral"]], "label string")
    found = {r["label"]: r for r in profile.class_weights(df, "label").collect()}
    assert found["positive"]["weight"] == pytest.approx(7 / 12) and found["neutral"]["weight"] == pytest.approx(7 / 3)
    assert sum(r["n"] * r["weight"] for r in found.values()) == pytest.approx(7)


def test_splits_are_disjoint_and_complete(separable):
    rows = split.stratified_split(separable, "id", "label").collect()
    assert len(rows) == 300 and sum(r["is_test"] for r in rows) == 60
    assert [separable.join(split.folds(separable, "id", "label", 3), "id").where(F.col("fold") == k).count() for k in range(3)] == [102, 99, 99]
    assert split.tuning_subset(separable, "id", "label", 50, 100).count() == 50


def test_naive_bayes(separable):
    weights = features.hashed(separable, "id", "text", by_term=True)
    model = naive_bayes.fit(weights, separable.select("id", "label"), 1.5, 1 << 18)
    rows = naive_bayes.predict(model, separable, weights).join(separable, "id").collect()
    assert all(r["prediction"] == r["label"] for r in rows)
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-9 for r in rows)
    empty = separable.limit(1).select((F.col("id") + 1000).alias("id"))
    assert naive_bayes.predict(model, empty, weights).first()["confidence"] == pytest.approx(1 / 3)


def test_no_terms(spark):
    with pytest.raises(ValueError, match="no terms"):
        features.fit_transform_tfidf(spark.createDataFrame([(1, "a few words")], "id long, text string"), "id", "text")


def test_metrics_without_rows(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "label string, prediction string")
    found = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert found["b"]["recall"] == 0 and found["c"]["precision"] == 0 and found["c"]["support"] == 0
    assert metrics.confusion_matrix(df).count() == 9
    assert metrics.weighted_metrics(df).first()["accuracy"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("name", [ml.LOGISTIC, ml.SVM])
def test_models_beat_the_majority(separable, name):
    trained = ml.train(separable, "text", "label", "id", name, max_features=50)
    assert ml.evaluate(trained).first()["accuracy"] > 0.9
    top = ml.feature_importance(trained, 1).where("direction = 'positive'").collect()
    assert {r["class"]: r["term"] for r in top}["positive"].startswith("great")
    label, shares = ml.predict_one(trained, "great shared words")
    assert label == "positive" and sum(shares.values()) == pytest.approx(1)


def test_tuning_tries_every_setting(spark, separable):
    vectors = ml.feature_stages(ngram_range=(1, 2))
    for name, classes, n in [(ml.LOGISTIC, 3, 160), (ml.BAYES, 3, 64), (ml.SVM, 2, 96), (ml.SVM, 3, 96), (ml.FOREST, 3, 144)]:
        maps = ml.parameter_grid(name, ml.estimator(name, 100, classes), 100, vectors)
        assert len({str(sorted((str(k), str(v)) for k, v in m.items())) for m in maps}) == n
    words, pairs = (ml.Pipeline(stages=vectors).copy(m).fit(separable.withColumnRenamed("text", "processed_text")).stages[-1].vocabulary for m in (maps[0], maps[-1]))
    assert not any(" " in t for t in words) and any(" " in t for t in pairs)
    assert ml.parameter_grid("other", None, 1, vectors) == []


def test_registry(spark, separable, tmp_path):
    weights = features.hashed(separable, "id", "text", by_term=True)
    model = naive_bayes.fit(weights, separable.select("id", "label"))
    found = registry.Registry(spark, str(tmp_path / "models"))
    assert found.models().count() == 0
    found.save_tables("nb", {"classes": model.classes, "terms": model.terms}, {"accuracy": 1.0})
    tables, values, _ = found.load("nb")
    assert tables["terms"].count() == model.terms.count() and values == {"accuracy": 1.0}
    found.delete("nb")
    with pytest.raises(FileNotFoundError):
        found.load("nb")


def test_tolerant_csv(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Id,Id,text\n1,2,plain\n3,4,one,too many\n5,6\n7,8,last\n")
    rows = csv.read_tolerant(spark, str(path))
    assert rows.columns == ["Id", "Id_1", "text"]
    assert sorted(map(tuple, rows.collect())) == [(1, 2, "plain"), (5, 6, None), (7, 8, "last")] and rows.count() == 3


def test_column_choice_and_checks(spark):
    assert columns.default_columns(["Id", "Review_Text", "Rating"])[0] is not None
    df = spark.createDataFrame([("a text", 1, "x")], "t string, s int, t2 string")
    columns.check_columns(df, "t", "s")
    for text, sentiment in (("none", "s"), ("t", "t"), ("s", "t")):
        with pytest.raises(ValueError):
            columns.check_columns(df, text, sentiment)
    shown = columns.preview(df.toDF("a", "a", "b"), 5, 2)
    assert shown.columns == ["a", "a_1"] and shown.count() == 1


def test_bounded_reads_and_listings(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("a,b\n" + "1,2\n" * (10 * k + 1))
    (tmp_path / "x.txt").write_text("no csv")
    found = [r["path"].rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()]
    assert found == ["0.csv", "1.csv", "2.csv"]
    assert files.list_files(spark, str(tmp_path), min_bytes=40).count() == 2
    assert files.largest_file(spark, str(tmp_path), over_mb=0).first()["path"].endswith("2.csv")
    assert files.largest_file(spark, str(tmp_path)).count() == 0
    assert files.head(spark.range(100), 7).count() == 7


def test_word_joins_agree(spark, separable, monkeypatch):
    """Broadcast and salted joins give the same scores and stems."""
    from opinionmill.operators import joins, preprocess

    def results():
        weights = features.hashed(separable, "id", "text", by_term=True)
        found = naive_bayes.predict(naive_bayes.fit(weights, separable.select("id", "label"), 1.5, 1 << 18), separable, weights)
        closed = naive_bayes.predict(naive_bayes.fit(weights, separable.select("id", "label")), separable, weights)
        stems = preprocess.preprocess(separable, "text", perform_stemming=True, perform_lemmatization=False, id_col="id")
        rows = [(r["id"], r["prediction"], round(r["confidence"], 9)) for d in (found, closed) for r in d.collect()]
        return sorted(rows), sorted((r["id"], r["processed_text"]) for r in stems.collect())

    first = results()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert results() == first
