"""Every query with SQL gives the same rows in both engines."""

import math
import os

import duckdb
import pytest

from tests.conftest import TINY
from veilspark.plans import catalog

SLOW = {"coverage_monotone"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(TINY):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TINY}/{f}'")
    return c


def rows(frame):
    def cell(v):
        return "NULL" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_matches_sql(spark, con, name):
    got, want = catalog.queries()[name](spark, TINY).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql_but_the_cache():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"session_lru"}


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
