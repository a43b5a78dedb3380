"""Large groups of sets that share keys without being linked: links found, and how often sets are moved."""

import random

import pytest

import corpus_pipeline
from opinionmill.llm import ngram_join

from .test_operators import brute_components, by_id, shingles


def family(n, words=120, least=1, most=3, seed=4):
    """Texts of one template with some words of their own: some pairs are linked, most are near the threshold."""
    r = random.Random(seed)
    base, rows = [f"w{k}" for k in range(words)], []
    for i in range(n):
        text = list(base)
        for at in r.sample(range(words), r.randint(least, most)):
            text[at] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(text[: words - r.choice([0, 0, 0, 30])])))
    return rows


def moved(spark, rows, monkeypatch):
    """near_duplicates' rows, and the rows that its search of open groups moved."""
    counts, join = [], ngram_join._join_groups

    def spied(sets, num, den):
        counts.append(sets.count())
        return join(sets, num, den)

    monkeypatch.setattr(ngram_join, "_join_groups", spied)
    found = by_id(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, (80, 100)))
    return found, counts[-1]


@pytest.mark.parametrize(("block", "large"), [(4, 8), (4, 30), (128, 2048)])
def test_open_groups_in_blocks_equal_brute_force(spark, monkeypatch, block, large):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "OPEN_BLOCK", large, raising=False)
    rows = family(160)
    found, n = moved(spark, rows, monkeypatch)
    assert n > 100
    assert {i: f["component_id"] for i, f in found.items()} == brute_components({i: shingles(t, 5) for i, t in rows}, 80, 100)


def test_sets_of_an_open_group_are_moved_few_times(spark, monkeypatch):
    rows = family(500, least=2)
    _, n = moved(spark, rows, monkeypatch)
    assert 300 < n <= 1000


def test_texts_stay_where_they_are_when_few_documents_go(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, "another text"), (None, "another text"), (None, None)]
    # An id with two texts, one of which nothing is like, stays with both.
    rows += [(4, "one two three four five six"), (4, "")]
    near = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in near.collect()) == sorted((str(i), str(t)) for i, t in rows if i != 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
