"""Every registered query next to its oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entrypoint
from check import TABLES, normalise

ORACLES = entrypoint.oracle_sql()
QUERIES = entrypoint.queries()
# run once per round by check.py; too slow to repeat in the unit tests
SLOW = {"train_and_score", "search", "report", "attribution_mlp"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    if name in SLOW:
        pytest.skip("covered by check.py")
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normalise(got) == normalise(want)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entrypoint.entry(spark).columns[:2] == ["admission_id", "person_id"]
