"""Queries that SQL can express, against it, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vertexloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = QUERIES[name](spark, SF), c.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    mine = sorted(tuple(r) for r in got.select(*columns).collect())
    assert mine == sorted(tuple(r) for r in want.select(*[duckdb.ColumnExpression(x) for x in columns]).fetchall())
