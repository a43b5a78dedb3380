"""The pipeline on the smallest tables, against a brute-force version of its copy and near-copy stages."""

from pathlib import Path

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:2]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, DATA).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.drop_copies(spark, docs, DATA).persist()
    last = {t: max(i for i, u in texts.items() if u == t) for t in texts.values()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(last.values())
    groups = brute_components({i: shingles(texts[i], 5) for i in last.values()}, 80, 100)
    near = corpus_pipeline.drop_near_copies(spark, kept, DATA)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(groups.values()))
    packed = corpus_pipeline.pack(spark, near, DATA)
    assert {r["doc_id"] for r in packed.collect()} == set(groups.values())


def test_stages_on_odd_rows(spark):
    """Null ids, null and empty texts, rows that are there twice, and an empty table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text without an id", "en", "s", 20), (7_000_001, None, None, None, None), (7_000_002, "", "en", "s", 0), (7_000_003, "twice", "en", "s", 5), (7_000_003, "twice", "en", "s", 5)], docs.schema)
    some = docs.limit(30).unionByName(odd)
    kept = corpus_pipeline.drop_copies(spark, some, DATA).where("doc_id > 7000000 or doc_id is null").collect()
    # Null and empty texts are copies of each other; the largest id stays.
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("7000002", ""), ("7000003", "twice"), ("None", "a text without an id")]
    near = corpus_pipeline.drop_near_copies(spark, odd.where("doc_id is null or doc_id < 7000003"), DATA)
    assert near.count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
