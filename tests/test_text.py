import pytest
from pyspark.sql import functions as F

from opinionmill.functions import text as T
from opinionmill.functions.labels import normalise
from opinionmill.functions.stem import stem
from opinionmill.operators.preprocess import preprocess


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_cleaning(spark):
    assert one(spark, "This is a TEST with punctuation!!!", T.processed) == "test punctuation"
    assert "not_good" in one(spark, "This product is not good and isn't working.", T.processed).split()
    assert "isnot_working" in one(spark, "This product is not good and isn't working.", T.processed).split()
    assert one(spark, "cannot do, it isn't working. don't! not  été knot tied", lambda c: T.join_negations(F.lower(c))) == "cannot_do, it isnot_working. do not! not_été knot_tied"
    assert one(spark, "knot tied", lambda c: T.join_negations(c, word_boundary=True)) == "knot tied"
    for blank in (None, "", "  \t", " "):
        assert one(spark, blank, T.processed) == ""


def test_ngrams(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>").select(T.ngrams(F.col("w"), 1, 2)).collect()
    assert [r[0] for r in rows] == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_lemmas(spark):
    lexicon = spark.createDataFrame(
        [("running", "v", "run"), ("jumping", "v", "jump"), ("driving", "v", "drive"), ("cars", "n", "car")], "form string, pos string, lemma string"
    )
    rows = spark.createDataFrame([(1, "I am running and jumping while cars were driving by."), (2, None)], "id int, t string")
    found = {r["id"]: r["processed_text"].split() for r in preprocess(rows, "t", id_col="id", lexicon=lexicon).collect()}
    assert {"run", "jump", "car", "drive"} <= set(found[1]) and "running" not in found[1] and found[2] == []


def test_stemmer():
    pairs = dict(caresses="caress", ponies="poni", agreed="agre", hopping="hop", filing="file", happy="happi", relational="relat", adoption="adopt", rate="rate", controll="control")
    assert {w: stem(w) for w in pairs} == pairs


@pytest.mark.parametrize(
    "raw, label",
    [("Positive", "positive"), ("1", "positive"), ("TRUE", "positive"), ("4", "positive"), ("no", "negative"), ("2", "negative"), ("0", "negative"), ("3", "neutral"), (None, "neutral"), ("", "neutral"), ("5.0", "neutral"), (" pos", "neutral")],
)
def test_labels(spark, raw, label):
    assert one(spark, raw, normalise) == label


def test_stars(spark):
    assert [one(spark, str(k), lambda c: normalise(c, "stars")) for k in range(1, 6)] == ["negative", "negative", "neutral", "positive", "positive"]
