"""Every graph query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from vertexloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda found: sorted(tuple(r) for r in found)
    mine = rows(got.select(*columns).collect())
    theirs = rows(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", ["partition_greedy", "partition_degree_alpha"])
def test_greedy_parts_cover_all_and_are_balanced(spark, name):
    rows = QUERIES[name](spark, SF).groupBy("part").count().collect()
    assert sum(r["count"] for r in rows) == 200 and len(rows) == 8
    assert max(r["count"] for r in rows) <= 2 * min(r["count"] for r in rows)


def test_entry_point_registers_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
