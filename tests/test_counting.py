"""Counts made row by row against plain ones, and where no shuffle may be."""

import math
from collections import Counter

from pyspark.sql import functions as F

from opinionmill.operators import counting, features, naive_bayes
from opinionmill.session import stored

TEXTS = [(1, "red red blue red red"), (2, ""), (3, None), (4, "blue"), (5, "x red blue green blue red blue"), (6, "green red")]


def plain(text, high):
    words = [w for w in (text or "").split() if len(w) > 1]
    return Counter(" ".join(words[i : i + n]) for n in range(1, high + 1) for i in range(len(words) - n + 1))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_counted_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(counting, "TOKENS", 4)
    df = spark.createDataFrame(TEXTS, "i long, t string").coalesce(1)
    for high in (1, 2, 3):
        found = features.term_rows(df, "i", "t", (1, high), [])
        assert "Exchange" not in plan(found)
        assert sorted(map(tuple, found.collect())) == sorted((i, term, n) for i, t in TEXTS for term, n in plain(t, high).items())
    weights = features.hashed(df, "i", "t", ngram_range=(1, 2), by_term=True)
    assert "Exchange" not in plan(weights)
    want = {(i, term): n / math.sqrt(sum(k * k for k in plain(t, 2).values())) for i, t in TEXTS for term, n in plain(t, 2).items()}
    found = {(r["id"], r["term"]): r["weight"] for r in weights.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_rows_of_one_id_are_added_up(spark):
    df = spark.createDataFrame([(1, "red blue"), (1, "red green"), (None, "red"), (None, "red"), (2, "red")], "i long, t string")
    found = features.term_rows(df, "i", "t", (1, 2), [])
    want = [(None, "red", 2), (1, "blue", 1), (1, "green", 1), (1, "red", 2), (1, "red blue", 1), (1, "red green", 1), (2, "red", 1)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    model = spark.createDataFrame([("red", 1.0), ("blue", 2.0)], "term string, idf double")
    weights = {(r["id"], r["term"]): r["weight"] for r in features.tfidf_rows(df, "i", "t", model, (1, 2), []).collect()}
    red = 1 + math.log(2)
    assert abs(weights[1, "blue"] - 2 / math.hypot(red, 2)) < 1e-12 and weights[2, "red"] == 1.0 and len(weights) == 4


def test_weights_are_read_once_for_all_sums(spark):
    rows = spark.createDataFrame([(1, "red blue", "a"), (2, "blue", "b"), (3, "red", "a")], "i long, t string, label string")
    model = naive_bayes.fit(features.hashed(rows, "i", "t", by_term=True, keep=["label"]), rows.select(F.col("i").alias("id"), "label"), 1.5, 100)
    model = naive_bayes.NaiveBayes(stored(model.classes, "classes"), stored(model.terms, "terms"), model.closed, model.features)
    asked = spark.createDataFrame([(7, "red unseen"), (8, "")], "id long, t string")
    scored = naive_bayes.scores(model, asked, features.hashed(asked, "id", "t", by_term=True))
    assert plan(scored).count("MapInArrow") == 1
    totals, sums = {"a": 1 + math.sqrt(2), "b": 1.0}, {"a": 1 + math.sqrt(0.5), "b": 0.0}
    base = {c: math.log(1.5 / (totals[c] + 150)) for c in totals}
    want = {(7, c): math.log({"a": 2, "b": 1}[c] / 3) + math.sqrt(0.5) * (base[c] + math.log((sums[c] + 1.5) / (totals[c] + 150))) for c in totals}
    want |= {(8, c): math.log({"a": 2, "b": 1}[c] / 3) for c in totals}
    found = {(r["id"], r["label"]): r["score"] for r in scored.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_files_of_a_stream_follow_the_rows(spark, monkeypatch):
    from opinionmill.plans import queries

    monkeypatch.setattr(queries, "STREAM_ROWS", 100)
    made, folder = [], queries.shared_folder
    monkeypatch.setattr(queries, "shared_folder", lambda *a: made.append(folder(*a)) or made[-1])
    stream = queries._review_stream(spark, "/root/testdata/sf0.001")
    n = queries.reviews(spark, "/root/testdata/sf0.001").count()
    assert len(spark.read.parquet(made[0]).inputFiles()) >= n // 100 > 8
    query = stream.writeStream.format("noop").option("checkpointLocation", folder(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    assert sum(rows) == n and len(rows) == 4


def test_lines_are_put_together_once(spark, tmp_path):
    from opinionmill.sources import split_csv

    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines"\n2,plain\n')
    rows = split_csv.read_strict_split(spark, str(tmp_path))
    assert sorted(map(tuple, rows.collect())) == [(1, "two\nlines"), (2, "plain")]
    assert "MapInArrow" not in plan(rows)


def test_features_are_made_by_all_tasks(spark, monkeypatch):
    from pyspark.ml.classification import LogisticRegression

    from opinionmill.operators import ml

    seen = []
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, rows, fit=LogisticRegression._fit: seen.append(plan(rows)) or fit(self, rows))
    docs = spark.createDataFrame([(k, f"{'good fine' if k % 2 else 'bad poor'} word{k % 3}", "ab"[k % 2]) for k in range(60)], "i long, t string, y string").repartition(4)
    trained = ml.train(docs, "t", "y", "i", ml.LOGISTIC, min_df=1.0)
    assert len(seen) == 1 and "parquet" in seen[0] and "ArrowEvalPython" not in seen[0]
    assert ml.evaluate(trained).first()["accuracy"] == 1.0


def test_vocabulary_of_texts_is_that_of_their_counts(spark, monkeypatch):
    import random

    pick, letters = random.Random(7), "abcdefgh"
    texts = [(k, " ".join(pick.choice(letters) * pick.choice((2, 2, 3)) for _ in range(pick.randrange(14))) if k % 9 else None) for k in range(80)]
    df = spark.createDataFrame(texts + [(80, "rare pair " * 9), (81, "rare pair"), (82, "aa aa aa aa")], "i long, t string").repartition(3)
    asked = []
    monkeypatch.setattr(features, "term_totals", lambda lists, ngram_range=(1, 1), words=None: asked.append((ngram_range, words)) or counting.term_totals(lists, ngram_range, words))
    split = features.tokens(df, "i", "t", [])
    cases = [(2, {"min_df": 1, "max_features": 5}), (3, {"min_df": 3, "max_features": 40}), (2, {"min_df": 2, "max_df": 0.4, "max_features": 12}), (2, {"max_features": None}), (3, {"min_df": 3})]
    for high, options in cases:
        want = sorted(map(tuple, features.fit_tfidf(features.term_rows(df, "i", "t", (1, high), []), 83, **options).collect()))
        for bound in (200_000, 3):
            monkeypatch.setattr(features, "MAX_WORDS", bound)
            assert sorted(map(tuple, features.fit_texts(split, "id", "tokens", 83, ngram_range=(1, high), repeats=False, **options).collect())) == want
    # Pairs are counted only of the words that are frequent enough; `rare` is in two texts.
    asked.clear()
    monkeypatch.setattr(features, "MAX_WORDS", 200_000)
    features.fit_texts(df, "i", "t", 83, min_df=3, max_features=4, stop_words=[])
    assert [r for r, _ in asked] == [(1, 1), (2, 2)] and 4 <= len(asked[1][1]) < 16 and "rare" not in asked[1][1]


def test_ids_that_repeat_have_one_count_a_vocabulary_term(spark):
    df = spark.createDataFrame([(1, "red blue"), (1, "red blue"), (2, "red")], "i long, t string")
    found = features.fit_texts(df, "i", "t", 2, min_df=1, max_df=1.0, stop_words=[])
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("blue", 1, 2), ("red", 2, 3), ("red blue", 1, 2)]


def test_documents_are_cut_into_tokens_once(spark):
    from opinionmill.plans import queries

    _, train, test, model = queries._tfidf_parts(spark, "/root/testdata/sf0.001")
    for df in (train, test, model):
        assert "parquet" in plan(df) and "regexp_extract_all" not in plan(df)
