"""Operators that SQL can express, against DuckDB on a whole small table."""

from __future__ import annotations

import os

import duckdb
import pytest

from dealgrid.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    rel = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})")
    key = lambda row: tuple((x is None, x) for x in row)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rel.fetchall(), key=key)
