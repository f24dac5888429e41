"""Every registered query against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import skein.budget_queries
import skein.drift_queries
import skein.grammar_queries
import skein.measurement_queries
import skein.store_queries
import skein.walk_queries  # noqa: F401
from skein.queries import ORACLE, QUERIES


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None or isinstance(value, (str, bytes)):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    rows = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert got == rows
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
