"""Several templates in a leaf, bounded samples, ids with several vectors; line templates against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from opinionmill.llm import embed_dedup, line_templates, ngram_join, quality, toxicity
from opinionmill.llm.common import labelled_sample

from .test_operators import shingles


def brute_lines(rows, lead=3, similar=60, least=10, long_words=50):
    """doc id to the numbers of its dropped lines; rows: (id, text), ids once."""
    lines = []
    for i, text in rows:
        for at, raw in enumerate((text or "").split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.split(r"[ \t\r\f\v]+", raw) if t]
            if tokens:
                lines.append((i, at, tuple(tokens)))
    docs, texts = defaultdict(set), defaultdict(set)
    by_id = dict(rows)
    for i, _, tokens in lines:
        docs[tokens].add(i)
        texts[tokens].add(by_id[i])
    leaves = defaultdict(list)
    for tokens in docs:
        leaves[len(tokens), tokens[:lead]].append(tokens)
    agree = lambda a, b: (n := sum(x == y for x, y in zip(a[lead:], b[lead:]))) > 0 and 100 * n >= similar * (len(a) - lead)
    members = defaultdict(list)
    for own in leaves.values():
        rest = [t for t in own if len(t) > lead]
        while True:
            usual, lined = Counter(), Counter()
            for t in rest:
                for place in enumerate(t[lead:]):
                    usual[place] += len(docs[t])
                    lined[place] += 1
            mass = {t: sum(usual[p] for p in enumerate(t[lead:])) for t in rest}
            home = {t: min(((-usual[p], *p) for p in enumerate(t[lead:]) if lined[p] > 1), default=(t,)) for t in rest}
            rank = lambda t: (-mass[t], -len(docs[t]), " ".join(t).encode())
            best = {}
            for t in rest:
                if 100 * mass[t] >= similar * least * (len(t) - lead) and (home[t] not in best or rank(t) < rank(best[home[t]])):
                    best[home[t]] = t
            few = sorted(best.values(), key=rank)[: line_templates.FOUNDERS]
            founders = [f for k, f in enumerate(few) if not any(agree(f, g) for g in few[:k])]
            if not founders:
                break
            left = []
            for t in rest:
                first = next((f for f in founders if agree(t, f)), None)
                if first is None:
                    left.append(t)
                else:
                    members[first].append(t)
            rest = left
    placed = {t: f for f, ts in members.items() for t in ts}
    for t in docs:
        placed.setdefault(t, t)
    found = defaultdict(set)
    for t, f in placed.items():
        found[f] |= docs[t]
    gone = {t for t in docs if len(found[placed[t]]) >= least or len(t) > long_words and len(texts[t]) >= 2}
    out = defaultdict(list)
    for i, at, tokens in lines:
        if tokens in gone:
            out[i].append(at)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(df).collect()}
    want = brute_lines(rows)
    for i, text in rows:
        kept = [x for at, x in enumerate((text or "").split("\n")) if at not in want[i]]
        assert (found[i]["n_dropped"], found[i]["text"]) == (len(want[i]), "\n".join(kept))
    return sum(map(len, want.values()))


@pytest.mark.parametrize("sizes", [[12] * 5, [12, 24, 36, 48, 60], [11] * 12])
def test_a_leaf_with_many_templates_loses_all_their_lines(spark, sizes):
    """The templates share token count and leading tokens; names vary."""
    r, rows = random.Random(1), []
    names = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    for k, n in enumerate(sizes):
        fixed = [f"{x}{chr(97 + k)}" for x in ("alpha", "beta", "gamma", "delta", "omega")]
        rows += [(1000 * k + i, f"See also the {fixed[0]} {fixed[1]} {r.choice(names)} {fixed[2]} {r.choice(names)} {fixed[3]} {fixed[4]}") for i in range(n)]
    assert check(spark, rows) == sum(sizes)


def test_line_templates_equal_brute_force(spark):
    r = random.Random(8)
    words = ["see", "the", "page", "for", "more", "news", "a", "x1", "of", "us"]
    rows = [(i, "\n".join(" ".join(r.choice(words[: 3 + j]) for _ in range(r.choice([2, 4, 5, 6]))) for j in range(6))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "\n\n")]
    assert 0 < check(spark, rows) < 900


def test_lines_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "same line of five words\nown one")] * 2 + [(i, f"same line of five words\nother {'x' * i}") for i in range(1, 10)] + [(3, "same line of five words\nother xxx")]
    df = spark.createDataFrame([(*x, "leaf", 1) for x in rows], "doc_id long, text string, leaf string, hash int")
    found = line_templates.drop_recurring_lines(df).collect()
    assert len(found) == len(rows) and {r["n_dropped"] for r in found} == {1}


def test_samples_are_bounds(spark):
    docs = spark.createDataFrame([(7, f"text {k}") for k in range(5000)] + [(i, f"own {i}") for i in range(100, 140)], "doc_id long, text string")
    labels = docs.select("doc_id").distinct().withColumn("label", F.col("doc_id") % 2)
    assert labelled_sample(docs, labels, 40).count() == 40
    assert labelled_sample(docs, labels, 100).count() == 41
    absent = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    present = absent.where("doc_id % 10 = 3").select("doc_id", F.lit("text").alias("text"))
    assert labelled_sample(present, absent, 100).count() == 100
    for fit in (toxicity.fit, quality.fit):
        model = fit(docs, labels, train_rows=40)
        assert model is not None
    repeated = labels.unionByName(labels.withColumn("label", F.lit(None).cast("long"))).unionByName(labels)
    assert labelled_sample(docs, repeated, 100).count() == 41


def test_an_id_with_several_vectors(spark):
    rows = [(2, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.05]), (9, [-1.0, 1.0]), (None, [1.0, 2.0]), (5, [9.0, 18.0]), (5, [0.0, -1.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rep int, weight int")
    found = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in embed_dedup.near_duplicates(df).collect())
    assert found == [("2", 3, "2"), ("2", 3, "2"), ("3", 3, "2"), ("5", 3, "2"), ("5", 3, "2"), ("9", 0, "9"), ("None", 0, "None")]
    three = [r for r in rows if r[0] in (2, 3)]
    small = embed_dedup.near_duplicates(spark.createDataFrame(three, "vec_id long, embedding array<double>")).collect()
    assert {(r["vec_id"], r["n_links"]) for r in small} == {(2, 2), (3, 2)}


@pytest.mark.parametrize("text", [1 << 26, 2000])
def test_buckets_follow_the_texts(spark, monkeypatch, text):
    """Two partitions and much text: as many buckets as the text needs, and the same links."""
    monkeypatch.setattr(ngram_join, "BUCKET_TEXT", text)
    r = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if r.random() > 0.01 else f"x{r.randint(0, 99)}" for w in base)) for k in range(40)] + [(100, None), (None, " ".join(base)), (None, None), (7, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        assert (ngram_join._bucket_count(df) > 4) == (text == 2000)
        found = ngram_join.near_duplicates(df, 3, (90, 100)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sets = [(i, shingles(t, 3)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    assert len(found) == len(rows)
    assert all(f["component_id"] == root(f["doc_id"]) for f in found if f["doc_id"] is not None)
