"""Corpus queries that SQL can express, against their SQL."""

import duckdb
import pytest

from curatrix.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    expected = sorted(want.select(*columns).fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == expected and expected
