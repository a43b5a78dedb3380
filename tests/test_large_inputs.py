"""Split CSV, positions, quantiles, sketches, observed counts, pairs, evaluation and progress of streams."""


import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from opinionmill.operators import columns, profile, quantiles, split, words
from opinionmill.sources import csv, files, positions, split_csv
from opinionmill.streaming import jobs, progress


def split_reads(spark, n_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "200")


@pytest.fixture
def small_ranges(spark):
    split_reads(spark, 64)
    yield spark
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_split_csv_equals_the_whole_read(small_ranges, tmp_path):
    """Quoted line breaks, some longer than a range, lie across the edges of ranges."""
    spark, r = small_ranges, np.random.default_rng(3)
    names = ["id", "a text", "flag", "x"]
    for part in range(2):
        lines = [",".join(names)]
        for k in range(60):
            text = "".join(r.choice(["word ", "\n", '""', ",", "é", "\n\n"], p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]) for _ in range(int(r.integers(0, 60))))
            lines.append(f'{k + 100 * part},"{text}",{["true", "false"][k % 2]},{k / 4}')
        (tmp_path / f"part{part}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    found = split_csv.read_strict_split(spark, str(tmp_path))
    assert split_csv.records(spark, str(tmp_path)).rdd.getNumPartitions() > 20
    assert split_csv._openings(spark, str(tmp_path)).where("inside").count() > 5
    whole = csv.read_strict(spark, str(tmp_path))
    assert found.schema.simpleString() == whole.schema.simpleString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    typed = split_csv.read_strict_split(spark, str(tmp_path), "id long, t string, flag string, x double")
    assert typed.agg(F.sum("id")).first()[0] == sum(range(60)) + sum(range(100, 160))


def test_split_csv_of_odd_files(spark, tmp_path):
    (tmp_path / "crlf.csv").write_bytes(b'a,b\r\n1,"x\r\ny"\r\n\r\n2,z\r\n')
    assert sorted(map(tuple, split_csv.read_strict_split(spark, str(tmp_path / "crlf.csv")).collect())) == [(1, "x\r\ny"), (2, "z")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        split_csv.read_strict_split(spark, str(tmp_path / "bad.csv"), "a int, b int").collect()
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        split_csv.read_strict_split(spark, str(tmp_path / "none.csv"))


def test_positions_follow_the_files(small_ranges, tmp_path):
    spark = small_ranges
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(50 + 30 * k)))
    rows = positions.with_positions(spark.read.text(str(tmp_path))).collect()
    want = [f"{k} {i}" for k in range(3) for i in range(50 + 30 * k)]
    assert [r["value"] for r in sorted(rows, key=lambda r: r["position"])] == want and {r["position"] for r in rows} == set(range(len(want)))
    few = split.thinned_by_position(spark.range(2000).withColumnRenamed("id", "position"), chunk_rows=10)
    chunks = {r["position"] // 10 for r in few.collect()}
    assert chunks == {c for c in range(200) if c <= 16 or c >= 184 or (c - 16) % 9 == 0}
    assert split.thinned_by_position(spark.range(50).withColumnRenamed("id", "position"), chunk_rows=10).count() == 50


@pytest.mark.parametrize("bins", [4, 1024])
def test_quantiles_equal_percentile(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    r = np.random.default_rng(2)
    for values in (r.integers(0, 100_000, 300), r.integers(-5, 5, 40), [7], [3, 9], [2**40, -(2**40), 0]):
        df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "v long")
        shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
        want = df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
        assert quantiles.exact_quantiles(df, F.col("v"), shares) == pytest.approx(want)
    assert quantiles.exact_quantiles(df.limit(0), F.col("v"), [0.5]) is None
    assert profile.text_length_stats(spark.createDataFrame([], "t string"), "t").first()["p50"] is None


def test_sketches_decide_like_counts(spark):
    df = spark.range(30_000).select(
        (F.col("id") % 29_990).alias("c0"), F.concat(F.lit("a text of some length "), "id").alias("c1"), (F.col("id") % 3001).alias("c2"), (F.col("id") % 2999).alias("c3"), (F.col("id") % 6).cast("double").alias("c4")
    )
    estimates = {r["column"]: r["distinct"] for r in columns.column_stats(df, exact=False).collect()}
    exact = {r["column"]: r["distinct"] for r in columns.column_stats(df).collect()}
    assert all(abs(estimates[c] - exact[c]) <= 5 * columns.SKETCH_ERROR * exact[c] + 1 for c in exact)
    near = columns._counted_near_limits(df, estimates, 3000)
    assert (near["c2"], near["c3"], near["c4"]) == (3001, 2999, 6)
    assert columns.detect_columns(df.select("c0", "c1", "c2", "c3")) == ("c1", "c3")
    assert columns.detect_columns(df) == ("c1", "c4")


def test_dropped_rows_are_observed(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",), ("c",)], "label string")
    classes = spark.createDataFrame([("a",), ("b",), ("a",)], "label string")
    seen = Observation("classes")
    kept = profile.keep_classes(df, "label", classes, seen)
    assert sorted(r["label"] for r in kept.collect()) == ["a", "a", "b"]
    assert seen.get == {"kept": 3, "dropped": 2}
    assert kept.columns == profile.keep_classes(df, "label", classes).columns


def test_pairs_of_a_cloud(spark):
    rows = [("x", ["new", "york"] * 1 + [f"w{k}"]) for k in range(30)] + [("x", ["new", "shop"]), ("x", []), ("x", None), ("y", ["lone"])]
    df = spark.createDataFrame(rows, "by string, tokens array<string>")
    found = {(r["by"], r["word"]): r["n"] for r in words.cloud_phrases(df, "tokens", "by").collect()}
    assert found["x", "new york"] == 30 and found["x", "new"] == 1 and ("x", "york") not in found and found["y", "lone"] == 1


@pytest.mark.parametrize("n_files, a_batch", [(1, 1), (5, 1), (7, 3)])
def test_held_out_rows_do_not_depend_on_batches(spark, tmp_path, n_files, a_batch):
    rows = spark.range(400).select(F.col("id").alias("rid"), F.concat(F.lit("word "), F.col("id") % 7).alias("t"), (F.col("id") % 3 + 3).cast("string").alias("l"))
    rows.repartition(n_files).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), rows.schema, files_per_batch=a_batch)
    out = str(tmp_path / "out")
    jobs.train_and_hold_out(stream, "rid", "t", "l", out, str(tmp_path / "check"), cap=30)
    want = split.capped_evaluation(split.hash_split(rows.withColumnRenamed("rid", "id"), "id"), "id", 30)
    assert sorted(r["id"] for r in jobs.held_out_rows(spark, out).collect()) == sorted(r["id"] for r in want.collect())
    trained = jobs.model_of_deltas(spark, f"{out}/counts").classes.agg(F.sum("n")).first()[0]
    assert trained == split.hash_split(rows, "rid").where("not is_test").count()
    assert jobs.evaluate_held_out(spark, out).count() == 30


def test_progress_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, None if k == 3 else "text", str(k % 6)) for k in range(40)], "id long, t string, l string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    listener = progress.watch(spark)
    stream = progress.observed(jobs.file_stream(spark, str(tmp_path / "in"), rows.schema), "t", "l")
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    listener.wait(query.id)
    spark.streams.removeListener(listener)
    found = listener.table(spark)
    assert found.count() == 4 and {r["query"] for r in found.collect()} == {str(query.id)}
    row = found.agg(*[F.sum(c).alias(c) for c in ("n_rows", "missing", *progress.CLASSES)]).first().asDict()
    assert row == {"n_rows": 40, "missing": 1, "positive": 19, "negative": 14, "neutral": 7}


def test_samples_are_written(spark, tmp_path):
    df = spark.range(500).select("id", F.lit("a, b").alias("t"))
    files.write_sample(df, str(tmp_path / "s"), "id", 100)
    again = csv.read_strict(spark, str(tmp_path / "s"))
    assert 60 < again.count() < 140 and again.columns == ["id", "t"]
    files.write_sample(df, str(tmp_path / "s2"), "id", 100)
    assert sorted(map(tuple, csv.read_strict(spark, str(tmp_path / "s2")).collect())) == sorted(map(tuple, again.collect()))


def test_sniffing():
    assert [csv.sniff(h) for h in ("id,a text,b", "id text rating", "id;a b;c", "a:b:c", "a\tb c", "one")] == [",", " ", ";", ":", "\t", ","]
