"""The registry: queries run, and agree with their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from evenkeel import queries

DATA = Path("/root/testdata/sf0.001")
SLOW = {"stream_foreach_batch"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    plain = lambda v: None if v != v else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v)
    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def test_every_sql_belongs_to_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - SLOW))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0
