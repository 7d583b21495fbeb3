"""The queries that have SQL, against DuckDB on the same tables."""

import duckdb
import pytest

from gatehouse.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
