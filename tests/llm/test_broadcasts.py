"""What joins broadcast is bounded in rows and bytes."""

import random

from pyspark.sql import functions as F

from opinionmill.llm import common

from .test_mended import check


def test_many_rows_are_not_broadcast_by_spark_either(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 50)
    many, few = spark.range(100), spark.range(20)
    plan = lambda rows: spark.range(1000).join(common.if_small(rows), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan(many)
    assert "BroadcastHashJoin" in plan(few)


def test_founders_of_long_lines_are_not_broadcast(spark, monkeypatch):
    """A hundred leaves with long founders are few rows of much text."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 20_000, raising=False)
    sizes, broadcast = [], F.broadcast

    def spied(rows):
        texts = F.octet_length(F.to_json(F.struct(*rows.columns)))
        sizes.append((rows.columns, rows.agg(F.sum(texts)).first()[0] or 0))
        return broadcast(rows)

    monkeypatch.setattr(F, "broadcast", spied)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    lines = [" ".join(word() for _ in range(40)) for _ in range(100)]
    rows = [(1000 * k + i, f"{line} {word()}") for k, line in enumerate(lines) for i in range(10)]
    assert check(spark, rows) == 1000
    assert sizes
    assert not [x for x in sizes if "founders" in x[0] and x[1] > 20_000]
