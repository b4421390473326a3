"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from feedloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    if hasattr(x, "asDict"):
        return tuple(map(_plain, x.asDict().values()))
    if isinstance(x, dict):
        return tuple(map(_plain, x.values()))
    return x


def same(df, con, sql):
    got_cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in got_cols) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    cols = list(rel.columns)
    assert sorted(cols) == got_cols
    want = sorted((tuple(_plain(r[cols.index(c)]) for c in got_cols) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
    assert want


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, con, name):
    same(entry.queries()[name](spark, sf), con, registry.oracle_sql()[name])
