"""Every query with SQL gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from opinionmill.plans.queries import ORACLES, QUERIES
from opinionmill.session import clear_shared, shared_folder

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    cell = lambda v: "null" if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str(tuple(cell(v) for v in r)) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLES[name]).df())


WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLES))


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_without_sql_ends(spark, name):
    """Trained models and the like: rows under a stable schema."""
    found = QUERIES[name](spark, DATA)
    rows = found.collect()
    assert rows and found.columns
    if {"accuracy", "f1"} <= set(found.columns):
        assert 0 <= rows[0]["f1"] <= 1 and rows[0]["n"] > 0


def test_stored_tables_are_removed(spark):
    folder = shared_folder(spark, "gone")
    spark.range(3).write.parquet(folder)
    assert clear_shared(spark) >= 1
    assert not Path(folder.removeprefix("file:")).exists() and clear_shared(spark) == 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
