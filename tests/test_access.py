import pytest
from pyspark.sql import functions as F

from vertexloom.functions import kernels
from vertexloom.model import Graph


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture(scope="module")
def star(spark):
    """0 -> 1, 2, 3; 3 -> 0; 4 alone."""
    e = spark.createDataFrame([(0, 0, 1, 1.0), (1, 0, 2, None), (2, 0, 3, 3.0), (3, 3, 0, 4.0)], "eid long, src long, dst long, w double")
    v = spark.createDataFrame([(i, float(i) if i != 2 else None) for i in range(5)], "id long, x double")
    return Graph(v, e)


def test_degrees_are_zero_without_edges(star):
    assert rows(star.out_degree()) == [(0, 3), (1, 0), (2, 0), (3, 1), (4, 0)]
    assert rows(star.in_degree()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]
    assert rows(star.degree()) == [(0, 4), (1, 1), (2, 1), (3, 2), (4, 0)]


def test_neighbours_in_all_forms(spark, star):
    ids = spark.createDataFrame([(0,), (0,), (4,)], "id long")
    assert rows(star.neighbors(ids), "id", "nbr") == [(0, 1), (0, 1), (0, 2), (0, 2), (0, 3), (0, 3)]
    assert rows(star.neighbors(ids, form="array"), "id", "nbrs") == [(0, [1, 2, 3]), (0, [1, 2, 3]), (4, [])]
    assert rows(star.neighbors(ids, form="padded"), "id", "nbrs", "mask") == [(0, [1, 2, 3], [True] * 3), (0, [1, 2, 3], [True] * 3), (4, [-1] * 3, [False] * 3)]
    assert rows(star.neighbors(ids, mode="all"), "id", "nbr", "dir")[:2] == [(0, 1, "out"), (0, 1, "out")]


def test_unknown_ids_raise_if_strict(spark, star):
    ids = spark.createDataFrame([(9,)], "id long")
    assert rows(star.neighbors(ids)) == []
    with pytest.raises(ValueError):
        star.neighbors(ids, strict=True)


def test_subgraphs(spark, star):
    ids = spark.createDataFrame([(0,), (3,)], "id long")
    assert rows(star.subgraph(ids).edges, "eid") == [(2,), (3,)]
    assert rows(star.slice(ids).edges, "eid") == [(0,), (1,), (2,), (3,)]
    assert rows(star.subgraph(ids, renumber=True).edges, "src", "dst") == [(0, 1), (1, 0)]


def test_attributes(spark, star):
    assert rows(star.select_vertices("x", lambda c: c > 2)) == [(3,), (4,)]
    assert rows(star.filter_edges("w IS NULL")) == [(1,)]
    up = spark.createDataFrame([(0, 9.0, True), (1, 9.0, False)], "id long, x double, mask boolean")
    assert rows(star.update_vertices(up, "x").vertices.fillna(-1.0)) == [(0, 9.0), (1, -1.0), (2, -1.0), (3, 3.0), (4, 4.0)]
    assert rows(star.update_edges(spark.createDataFrame([(0, "a")], "eid long, tag string"), "tag").edges.fillna("-"), "eid", "tag") == [(0, "a"), (1, "-"), (2, "-"), (3, "-")]


def test_ranges(spark):
    r = spark.createDataFrame([(0, 0, 2), (1, 5, 5), (2, 7, 4), (3, 18, 20), (4, None, 3)], "k long, start long, end long")
    assert rows(kernels.expand_ranges(r), "k", "value") == [(0, 0), (0, 1), (3, 18), (3, 19)]
    assert rows(kernels.padded_ranges(r, 3).filter("k < 2"), "k", "values") == [(0, [0, 1, -1]), (1, [-1] * 3)]


def test_scatter_has_identities(spark):
    r = spark.createDataFrame([(0, 2.0), (0, 4.0), (2, 3.0)], "i long, x double")
    assert rows(kernels.scatter(r, "i", "x", "mean", 4)) == [(0, 3.0), (1, 0.0), (2, 3.0), (3, 0.0)]
    assert rows(kernels.scatter(r, "i", "x", "min").fillna(-1.0)) == [(0, 2.0), (1, -1.0), (2, 3.0)]
    assert rows(kernels.scatter(r, "i", "x", "mul", 1)) == [(0, 8.0)]
    with pytest.raises(ValueError):
        kernels.scatter(r, "i", "x", "median", 1)


def test_balanced_split_takes_the_heaviest_first(spark):
    w = spark.createDataFrame([(0, 5), (1, 4), (2, 3), (3, 3)], "id long, weight long")
    assert rows(kernels.balanced_split(w, 2)) == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert rows(kernels.balanced_split(w.filter(F.lit(False)), 3)) == []
