import duckdb
import pytest

import __spark_entry__ as entry
from gatehouse.plans import queries

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    assert got
    if name in queries.ORACLE_SQL:
        rel = duck.sql(queries.ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        want = plain(tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall())
        assert len(got) == len(want)
        assert got == want
    if "status" in columns:
        assert len({r[columns.index("status")] for r in got}) > 1, "one status only says nothing"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
