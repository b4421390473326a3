"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from feedloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rel = con.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, sf)
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(rel.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=repr) == want and want
