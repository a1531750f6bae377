import pytest

from vertexloom.functions import prefix
from vertexloom.model import Graph
from vertexloom.operators import etl
from vertexloom.sources import synthetic


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(0, 1, 5), (0, 1, 3), (1, 1, 1), (2, 0, 7)], "src long, dst long, w long")


def test_dedupe_takes_the_least_attribute(edges):
    assert rows(etl.dedupe(edges)) == [(0, 1, 3), (1, 1, 1), (2, 0, 7)]


def test_loops_and_transposition(edges):
    assert rows(etl.drop_self_loops(edges)) == [(0, 1, 3), (0, 1, 5), (2, 0, 7)]
    assert rows(etl.transpose(etl.transpose(edges))) == rows(edges)


def test_undirected_graph_holds_both_directions_once(edges):
    g = Graph.from_edges(edges, directed=False)
    assert rows(g.edges, "eid", "src", "dst", "w") == [(0, 0, 1, 3), (1, 0, 2, 7), (2, 1, 0, 3), (3, 1, 1, 1), (4, 2, 0, 7)]
    assert rows(g.degree()) == [(0, 2), (1, 2), (2, 1)]


def test_renumber_keeps_the_order_of_ids(spark):
    e = spark.createDataFrame([(30, 10), (20, 30)], "src long, dst long")
    g = Graph.from_edges(e, renumber=True)
    assert rows(g.vertices, "id", "old_id") == [(0, 10), (1, 20), (2, 30)]
    assert rows(g.edges, "src", "dst") == [(1, 2), (2, 0)]


def test_offsets_count_vertices_without_edges(spark, edges):
    v = spark.range(4)
    assert rows(etl.offsets(v, edges)) == [(0, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 0)]


def test_csc_positions_follow_destination_then_source(spark, edges):
    g = Graph.from_edges(edges)
    by_eid = {r["eid"]: (r["dst"], r["src"]) for r in g.edges.collect()}
    order = [by_eid[r["eid"]] for r in etl.csc_positions(g.edges).orderBy("pos").collect()]
    assert order == sorted(order)


def test_violations(spark):
    v = spark.createDataFrame([(0,), (0,), (None,)], "id long")
    e = spark.createDataFrame([(0, 0, 9), (0, 0, 0)], "eid long, src long, dst long")
    assert {r["rule"] for r in etl.violations(v, e).collect()} == {"dst is no vertex", "vertex id is null", "vertex id repeats", "edge id repeats"}


def test_running_sum_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS x").repartition(13)
    got = prefix.running(df, ["id"], df["x"], "s").orderBy("id").collect()
    total = 0
    for r in got:
        assert r["s"] == total
        total += r["x"]


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert g.num_vertices() == g.num_edges() == 0
    assert rows(etl.offsets(g.vertices, g.edges)) == []


@pytest.mark.parametrize("name", ["tiny", "small"])
def test_generated_graphs(spark, name):
    n, m = synthetic.PRESETS[name]
    g = synthetic.preset(spark, name)
    e = rows(g.edges, "src", "dst")
    assert g.num_vertices() == n and len(e) == len(set(e)) == m
    assert all(a != b for a, b in e) and {(i, i + 1) for i in range(n - 1)} <= set(e)
    assert e == rows(synthetic.preset(spark, name).edges, "src", "dst")
    with pytest.raises(ValueError):
        synthetic.preset(spark, "huge")
