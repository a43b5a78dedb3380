"""Strings of tokens against lists of them: the same counts, sums and scores, with less sent to and from the tasks."""

import random

from pyspark.sql import functions as F

from opinionmill.operators import counting, features, joins, naive_bayes
from opinionmill.session import stored

from .test_counting import plan

DATA = "/root/testdata/sf0.001"


def texts(spark):
    pick, letters = random.Random(3), "abcdef"
    rows = [(k, " ".join(pick.choice(letters) * pick.choice((2, 2, 3)) for _ in range(pick.randrange(12))) if k % 7 else None, "xyz"[k % 3]) for k in range(90)]
    return spark.createDataFrame([*rows, (90, "äö ß1 the AA  aa", "x"), (91, "", "y")], "i long, t string, label string").repartition(3)


def rounded(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_strings_of_tokens_give_the_counts_of_lists(spark, monkeypatch):
    df = texts(spark)
    cut, lists = features.cut_texts(df, "i", "t"), features.tokens(df, "i", "t")
    assert cut.schema["tokens"].dataType.simpleString() == "string"
    for at_once, held in ((1 << 18, 1 << 20), (4, 3)):
        monkeypatch.setattr(counting, "TOKENS", at_once)
        monkeypatch.setattr(counting, "HELD", held)
        for span in ((1, 1), (1, 3), (2, 2)):
            want = rounded(counting.term_totals(lists.select("tokens"), span))
            assert rounded(counting.term_totals(cut.select("tokens"), span)) == want and want
        words = ["aa", "bb", "ccc", "äö", "ß1"]
        want = [r for r in want if set(r[0].split(" ")) <= set(words)]
        assert rounded(counting.term_totals(cut.select("tokens"), (2, 2), words)) == rounded(counting.term_totals(lists.select("tokens"), (2, 2), words)) == want and want


def test_pairs_are_shuffled_as_numbers(spark):
    found = plan(counting.term_totals(features.cut_texts(texts(spark), "i", "t").select("tokens"), (2, 2), ["aa", "bb"]))
    assert "hashpartitioning(pair" in found and "hashpartitioning(term" not in found


def test_sums_and_scores_are_made_where_the_rows_are(spark, monkeypatch):
    df = texts(spark)
    cut = stored(features.cut_texts(df, "i", "t", keep=["label"]), "tokens")
    for span, options in (((1, 2), {"min_df": 2, "max_features": 25}), ((1, 3), {"min_df": 2, "max_features": 60}), ((1, 2), {"min_df": 1000})):
        vocabulary = stored(features.fit_texts(cut, "id", "tokens", 92, ngram_range=span, cut=True, **options), "vocabulary")
        assert rounded(vocabulary) == rounded(features.fit_texts(df, "i", "t", 92, ngram_range=span, repeats=False, **options))
        # One model sees two classes of three, and so not all terms.
        for seen in (cut, cut.where("label <> 'z' and id < 12")):
            weights = features.tfidf_rows(seen, "id", "tokens", vocabulary, span, keep=["label"], cut=True)
            sums = naive_bayes.text_sums(seen, vocabulary, span)
            assert rounded(sums) == rounded(naive_bayes.term_sums(weights))
            model = naive_bayes.from_counts(naive_bayes.class_counts(seen), stored(sums, "sums"))
            asked = features.tfidf_rows(cut, "id", "tokens", vocabulary, span, cut=True)
            want = rounded(naive_bayes.scores(model, cut, asked))
            found = naive_bayes.text_scores(model, cut, vocabulary, span)
            assert rounded(found) == want and len(want) == 92 * model.classes.count() and "Exchange" not in plan(found)
            monkeypatch.setattr(naive_bayes, "BROADCAST_ROWS", -1)
            assert rounded(naive_bayes.text_scores(model, cut, vocabulary, span)) == want
            monkeypatch.undo()


def test_many_groups_are_sent_in_turns(spark, monkeypatch):
    df = texts(spark).withColumn("label", F.when(F.col("i") % 10 > 0, (F.col("i") % 10).cast("string")))
    vocabulary = spark.createDataFrame([("aa", 1.0), ("bb", 2.0), ("aa bb", 3.0)], "term string, idf double")
    cut = features.cut_texts(df, "i", "t", keep=["label"]).coalesce(1)
    key = lambda rows: sorted(rows, key=str)
    want = key((r["label"], r["term"], round(r["w"], 9)) for r in naive_bayes.text_sums(cut, vocabulary).collect())
    monkeypatch.setattr(counting, "GROUPS", 2)
    monkeypatch.setattr(counting, "TOKENS", 5)
    assert key((r["label"], r["term"], round(r["w"], 9)) for r in naive_bayes.text_sums(cut, vocabulary).collect()) == want
    assert any(r[0] is None for r in want)


def test_texts_are_never_sorted_for_a_join(spark, monkeypatch):
    rows, marks = spark.range(40).select("id", F.lit("text").alias("text")), spark.range(0, 80, 2).withColumn("mark", F.lit(True))
    for most, join in ((100, "BroadcastHashJoin"), (10, "ShuffledHashJoin")):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        found = joins.text_join(rows, marks, "id")
        assert sorted(r["id"] for r in found.collect()) == list(range(0, 40, 2))
        assert join in plan(found) and "Sort" not in plan(found)


def test_predictions_do_not_depend_on_how_ids_are_met(spark, monkeypatch):
    from opinionmill.plans import queries

    found = {}
    for repeat in (False, True):
        monkeypatch.setattr(counting, "ids_repeat", lambda *_: repeat)
        found[repeat] = rounded(queries.nb_predict_proba(spark, DATA))
    assert found[False] == found[True] and found[True]


def test_runs_of_rows_keep_all_tokens():
    import pyarrow as pa

    rows = pa.array([" ".join(f"w{k}x{j}" for j in range(k % 40)) for k in range(400)])
    for at in (0, 7, 150):
        names, codes, row = counting._coded(rows.slice(at, 200))
        assert [(r, names[c].as_py()) for r, c in zip(row.tolist(), codes.tolist())] == [(k, w) for k in range(200) for w in rows[at + k].as_py().split()]
