"""Queries over the derived graphs, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom import graphs
from vertexloom.algorithms import bfs, hits, pagerank, sssp, wcc
from vertexloom.algorithms import get_program
from vertexloom.algorithms.bfs import bfs_in_blocks, summary
from vertexloom.algorithms.pagerank import run as pagerank_run
from vertexloom.functions import kernels, prefix
from vertexloom.graphs import CUST_PART, GEO_TREE, PART_CHAIN, USER_NEXT, cust_part, geo_tree, part_chain, user_next
from vertexloom.model import Graph
from vertexloom.operators import access, etl, partition
from vertexloom.plans.program import VertexProgram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its name, with SQL if there is some."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


def _filled(df: DataFrame, column: str) -> DataFrame:
    return df.fillna(-1, [column])


# Construction


@query(f"WITH {PART_CHAIN} SELECT src, dst FROM e")
def edges_part_chain(spark, sf):
    return part_chain(spark, sf).edges


@query(f"WITH {CUST_PART} SELECT src, dst FROM e")
def edges_cust_part(spark, sf):
    return cust_part(spark, sf).edges


@query(f"WITH {USER_NEXT} SELECT src, dst, w FROM e")
def edges_user_next(spark, sf):
    return user_next(spark, sf).edges


@query(f"WITH {GEO_TREE} SELECT src, dst FROM e")
def edges_geo_tree(spark, sf):
    return geo_tree(spark, sf).edges


@query(f"WITH {PART_CHAIN} SELECT src, dst FROM e0 UNION ALL SELECT dst, src FROM e0")
def symmetrize(spark, sf):
    return etl.symmetrize(part_chain(spark, sf).edges)


@query("SELECT src, dst, min(w) AS w FROM (SELECT l_partkey AS src, l_suppkey AS dst, CAST(l_quantity AS BIGINT) AS w FROM lineitem) GROUP BY src, dst")
def dedupe_edges(spark, sf):
    lines = graphs.table(spark, sf, "lineitem")
    return etl.dedupe(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast("long").alias("w")))


@query("SELECT l_suppkey AS src, l_linenumber::BIGINT AS dst FROM lineitem WHERE l_suppkey <> l_linenumber")
def drop_self_loops(spark, sf):
    return etl.drop_self_loops(graphs.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").cast("long").alias("dst")))


@query(f"WITH {USER_NEXT} SELECT dst AS src, src AS dst, w FROM e")
def transpose_edges(spark, sf):
    return user_next(spark, sf).reverse().edges


@query(f"WITH {CUST_PART} SELECT DISTINCT src AS id FROM e")
def vertex_set(spark, sf):
    return etl.endpoints(cust_part(spark, sf).edges)


@query(f"""WITH {CUST_PART}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v)
SELECT s.i AS src, d.i AS dst FROM e JOIN m s ON s.id = e.src JOIN m d ON d.id = e.dst""")
def renumber_dense(spark, sf):
    g = cust_part(spark, sf)
    return etl.renumber(g.vertices, g.edges)[1]


@query(f"""WITH {GEO_TREE}, g AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)
SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "begin", degree FROM g""")
def csr_offsets(spark, sf):
    g = geo_tree(spark, sf)
    return etl.offsets(g.vertices, g.edges)


@query(f"""WITH {GEO_TREE}, g AS (SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id)
SELECT id, coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "begin", degree FROM g""")
def csc_offsets(spark, sf):
    g = geo_tree(spark, sf)
    return etl.offsets(g.vertices, g.edges, "dst")


@query(f"WITH {PART_CHAIN} SELECT eid, src, dst FROM e")
def edge_ids(spark, sf):
    return part_chain(spark, sf, ids=True).edges


@query(f"WITH {PART_CHAIN} SELECT row_number() OVER (ORDER BY dst, src, eid) - 1 AS pos, eid FROM e")
def csc_to_csr_edge_map(spark, sf):
    return etl.csc_positions(part_chain(spark, sf, ids=True).edges)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS rank FROM orders")
def counting_sort(spark, sf):
    return etl.counting_sort(graphs.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_orderkey", "rank")


@query(f"WITH {GEO_TREE} SELECT 'src is no vertex' AS rule, eid AS id FROM e WHERE src NOT IN (SELECT id FROM v) UNION ALL SELECT 'dst is no vertex', eid FROM e WHERE dst NOT IN (SELECT id FROM v)")
def validate_graph(spark, sf):
    g = geo_tree(spark, sf, ids=True)
    return etl.violations(g.vertices, g.edges)


@query("""SELECT 'src is no vertex' AS rule, 900000001::BIGINT AS id UNION ALL SELECT 'dst is no vertex', 900000002 UNION ALL SELECT 'vertex id is null', -1
UNION ALL SELECT 'vertex id repeats', r_regionkey::BIGINT FROM region UNION ALL SELECT 'edge id repeats', 900000003""")
def validate_broken_graph(spark, sf):
    """Regions stand twice among the vertices, one id is null, and of four added edges two lead nowhere and two share an id."""
    g = geo_tree(spark, sf, ids=True)
    some = g.vertices.agg(F.min("id")).first()[0]
    bad = spark.createDataFrame([(900000001, -5, some), (900000002, some, -6), (900000003, some, some), (900000003, some, some)], "eid long, src long, dst long")
    twice = graphs.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    vertices = g.vertices.union(twice).union(spark.createDataFrame([(None,)], "id long"))
    return _filled(etl.violations(vertices, g.edges.unionByName(bad)), "id")


# Access


@query(f"WITH {GEO_TREE} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges")
def graph_size(spark, sf):
    g = geo_tree(spark, sf)
    n, m = (t.agg(F.count("*").alias(c)) for t, c in ((g.vertices, "vertices"), (g.edges, "edges")))
    return n.join(F.broadcast(m))


def _degree_sql(ends: str, graph: str = GEO_TREE) -> str:
    return f"WITH {graph}, d AS (SELECT id, count(*) AS deg FROM ({ends}) GROUP BY id) SELECT v.id, coalesce(deg, 0) AS deg FROM v LEFT JOIN d USING (id)"


@query(_degree_sql("SELECT src AS id FROM e"))
def out_degree(spark, sf):
    return geo_tree(spark, sf).out_degree()


@query(_degree_sql("SELECT dst AS id FROM e"))
def in_degree(spark, sf):
    return geo_tree(spark, sf).in_degree()


def _with_eid(g: Graph) -> Graph:
    return Graph(g.vertices, g.edges.withColumn("eid", F.lit(0).cast("long")), g.directed)


@query(_degree_sql("SELECT src AS id FROM e UNION ALL SELECT dst FROM e"))
def all_degree(spark, sf):
    return _with_eid(geo_tree(spark, sf)).degree()


@query(_degree_sql("SELECT src AS id FROM e", CUST_PART))
def all_degree_undirected(spark, sf):
    return _with_eid(cust_part(spark, sf)).degree()


@query(f"WITH {PART_CHAIN}, d AS (SELECT src, count(*) AS deg FROM e GROUP BY src) SELECT deg, count(*) AS n FROM d GROUP BY deg")
def degree_histogram(spark, sf):
    return access.degree_histogram(part_chain(spark, sf))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every part, and the small ones twice."""
    parts = graphs.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return parts.select("id").union(parts.filter("p_size <= 10").select("id"))


ASKED = "a AS (SELECT p_partkey AS id FROM part UNION ALL SELECT p_partkey FROM part WHERE p_size <= 10)"


@query(f"WITH {PART_CHAIN}, {ASKED} SELECT id, dst AS nbr, eid, 'out' AS dir FROM a JOIN e ON e.src = a.id")
def out_nbrs_csr(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(_asked(spark, sf), "out")


@query(f"WITH {PART_CHAIN}, {ASKED} SELECT id, src AS nbr, eid, 'in' AS dir FROM a JOIN e ON e.dst = a.id")
def in_nbrs_csr(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(_asked(spark, sf), "in")


@query(f"""WITH {PART_CHAIN}, {ASKED} SELECT id, dst AS nbr, eid, 'out' AS dir FROM a JOIN e ON e.src = a.id
UNION ALL SELECT id, src, eid, 'in' FROM a JOIN e ON e.dst = a.id""")
def all_nbrs(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(_asked(spark, sf), "all")


@query(f"WITH {PART_CHAIN} SELECT src AS id, eid FROM e")
def out_edges_csr(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(mode="out").select("id", "eid")


@query(f"WITH {PART_CHAIN} SELECT dst AS id, eid FROM e")
def in_edges_csr(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(mode="in").select("id", "eid")


@query(f"WITH {PART_CHAIN} SELECT src AS id, eid FROM e UNION ALL SELECT dst, eid FROM e")
def all_edges_csr(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(mode="all").select("id", "eid")


def _strings(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(F.col(c).cast("array<string>"), ","))
    return df


@query(f"""WITH {GEO_TREE}, d AS (SELECT dst AS id, list(src ORDER BY src, eid) AS n, list(eid ORDER BY src, eid) AS x FROM e GROUP BY dst)
SELECT v.id, coalesce(array_to_string(n, ','), '') AS nbrs, coalesce(array_to_string(x, ','), '') AS eids FROM v LEFT JOIN d USING (id)""")
def in_nbrs_array(spark, sf):
    return _strings(geo_tree(spark, sf, ids=True).neighbors(mode="in", form="array"), "nbrs", "eids")


@query(f"""WITH {PART_CHAIN}, d AS (SELECT src AS id, list(dst ORDER BY dst) AS n FROM e GROUP BY src),
a AS (SELECT id, coalesce(n, []::BIGINT[]) AS n FROM v LEFT JOIN d USING (id)), w AS (SELECT max(len(n)) AS w FROM a)
SELECT id, array_to_string([CASE WHEN i <= len(n) THEN n[i] ELSE -1 END for i in range(1, w + 1)], ',') AS nbrs, len(n) AS n_real FROM a, w""")
def nbrs_padded(spark, sf):
    out = part_chain(spark, sf, ids=True).neighbors(mode="out", form="padded")
    return _strings(out.select("id", "nbrs", F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_real")), "nbrs")


def _padded_sql(rows: str, order: str, value: str, graph: str) -> str:
    return f"""WITH {graph}, n AS ({rows}), d AS (SELECT id, list({value} ORDER BY {order}) AS n FROM n GROUP BY id),
a AS (SELECT id, coalesce(n, []::BIGINT[]) AS n FROM v LEFT JOIN d USING (id)), w AS (SELECT max(len(n)) AS w FROM a)
SELECT id, array_to_string([CASE WHEN i <= len(n) THEN n[i] ELSE -1 END for i in range(1, w + 1)], ',') AS cells, len(n)::BIGINT AS n_real FROM a, w"""


def _padded(g: Graph, mode: str, column: str) -> DataFrame:
    out = g.neighbors(mode=mode, form="padded")
    return _strings(out.select("id", F.col(column).alias("cells"), F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_real")), "cells")


OUT, IN = "SELECT src AS id, dst AS nbr, eid, 'out' AS dir FROM e", "SELECT dst AS id, src AS nbr, eid, 'in' AS dir FROM e"


@query(_padded_sql(IN, "nbr, eid", "nbr", PART_CHAIN))
def in_nbrs_padded(spark, sf):
    return _padded(part_chain(spark, sf, ids=True), "in", "nbrs")


@query(_padded_sql(f"{OUT} UNION ALL {IN}", "dir, nbr, eid", "nbr", PART_CHAIN))
def all_nbrs_padded(spark, sf):
    return _padded(part_chain(spark, sf, ids=True), "all", "nbrs")


@query(_padded_sql(OUT, "nbr, eid", "eid", PART_CHAIN))
def out_edges_padded(spark, sf):
    return _padded(part_chain(spark, sf, ids=True), "out", "eids")


@query(_padded_sql(IN, "nbr, eid", "eid", PART_CHAIN))
def in_edges_padded(spark, sf):
    return _padded(part_chain(spark, sf, ids=True), "in", "eids")


@query(_padded_sql(f"{OUT} UNION ALL {IN}", "dir, nbr, eid", "eid", PART_CHAIN))
def all_edges_padded(spark, sf):
    return _padded(part_chain(spark, sf, ids=True), "all", "eids")


@query(f"WITH {PART_CHAIN} {OUT}")
def all_out_nbrs_csr(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(mode="out")


@query(f"WITH {PART_CHAIN} {IN}")
def all_in_nbrs_csr(spark, sf):
    return part_chain(spark, sf, ids=True).neighbors(mode="in")


@query(f"WITH {PART_CHAIN} SELECT count(*) AS vertices, (SELECT count(*) FROM e) AS edges FROM v")
def persisted_graph_size(spark, sf):
    g = part_chain(spark, sf, ids=True).persist()
    sizes = spark.createDataFrame([(g.num_vertices(), g.num_edges())], "vertices long, edges long")
    g.unpersist()
    return sizes


PICK = "part WHERE p_size <= 10"


def _small_parts(spark, sf):
    return graphs.table(spark, sf, "part").filter("p_size <= 10").select(F.col("p_partkey").alias("id"))


@query(f"WITH {PART_CHAIN}, a AS (SELECT p_partkey AS id FROM {PICK}) SELECT eid, src, dst FROM e WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)")
def induced_subgraph(spark, sf):
    return part_chain(spark, sf, ids=True).subgraph(_small_parts(spark, sf)).edges


@query(f"""WITH {PART_CHAIN}, a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM {PICK})
SELECT eid, s.i AS src, d.i AS dst FROM e JOIN a s ON s.id = e.src JOIN a d ON d.id = e.dst""")
def induced_subgraph_renumbered(spark, sf):
    return part_chain(spark, sf, ids=True).subgraph(_small_parts(spark, sf), renumber=True).edges


@query(f"WITH {PART_CHAIN} SELECT eid, src, dst FROM e WHERE src IN (SELECT p_partkey FROM {PICK})")
def row_slice_subgraph(spark, sf):
    return part_chain(spark, sf, ids=True).slice(_small_parts(spark, sf)).edges


def _priced(spark, sf) -> Graph:
    parts = graphs.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", F.col("p_retailprice").alias("price"))
    return Graph(parts, part_chain(spark, sf).edges)


@query("SELECT p_partkey AS id, p_retailprice AS price FROM part UNION ALL SELECT p_partkey, p_retailprice FROM part WHERE p_size <= 10")
def get_vertex_attr(spark, sf):
    return _priced(spark, sf).vertex_attr(_asked(spark, sf), "price")


@query("SELECT p_partkey AS id FROM part WHERE p_retailprice > 500")
def select_vertex_by_attr(spark, sf):
    return _priced(spark, sf).select_vertices("price", lambda c: c > 500)


@query("SELECT p_partkey AS id, p_size, CASE WHEN p_size <= 10 THEN CASE WHEN p_size % 2 = 0 THEN 0.0::DOUBLE ELSE -1 END ELSE p_retailprice END AS price FROM part")
def set_vertex_attr(spark, sf):
    g = _priced(spark, sf)
    updates = g.vertices.filter("p_size <= 10").select("id", F.lit(0.0).alias("price"), (F.col("p_size") % 2 == 0).alias("mask"))
    return _filled(g.update_vertices(updates, "price").vertices, "price")


@query(f"WITH {USER_NEXT} SELECT eid, w FROM e")
def get_edge_attr(spark, sf):
    g = user_next(spark, sf, ids=True)
    return g.edge_attr(g.edges.select("eid"), "w")


@query(f"WITH {USER_NEXT} SELECT eid FROM e WHERE w < 500")
def select_edge_by_attr(spark, sf):
    return user_next(spark, sf, ids=True).select_edges("w", lambda c: c < 500)


@query(f"WITH {USER_NEXT} SELECT eid, src, dst, CASE WHEN w < 500 THEN 2 * w ELSE w END AS w FROM e")
def set_edge_attr(spark, sf):
    g = user_next(spark, sf, ids=True)
    return g.update_edges(g.edges.filter("w < 500").select("eid", (2 * F.col("w")).alias("w")), "w").edges


# Segment and range functions


@query("SELECT o_orderkey, unnest(range(o_custkey % 5, o_orderkey % 7)) AS value FROM orders WHERE o_orderkey % 7 > o_custkey % 5")
def range_expand(spark, sf):
    ranges = graphs.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("start"), (F.col("o_orderkey") % 7).alias("end"))
    return kernels.expand_ranges(ranges).select("o_orderkey", "value")


@query("""SELECT o_orderkey, coalesce(sum(greatest(o_orderkey % 7 - o_custkey % 5, 0)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ptr
FROM orders""")
def range_pointers(spark, sf):
    ranges = graphs.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("start"), (F.col("o_orderkey") % 7).alias("end"))
    return kernels.range_offsets(ranges, ["o_orderkey"]).select("o_orderkey", "ptr")


@query("""SELECT o_orderkey, array_to_string([CASE WHEN o_custkey % 5 + i < o_orderkey % 7 THEN o_custkey % 5 + i ELSE -1 END for i in range(0, 6)], ',') AS "values" FROM orders""")
def range_padded(spark, sf):
    ranges = graphs.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("start"), (F.col("o_orderkey") % 7).alias("end"))
    return _strings(kernels.padded_ranges(ranges, 6), "values").select("o_orderkey", "values")


@query("""WITH c AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS r FROM lineitem),
x AS (SELECT l_suppkey, list(l_quantity::BIGINT ORDER BY r) AS x FROM c GROUP BY l_suppkey)
SELECT l_suppkey, array_to_string([CASE WHEN i <= len(x) THEN x[i] ELSE -1 END for i in range(1, 9)], ',') AS "values" FROM x""")
def csr_to_dense_truncated(spark, sf):
    return _strings(kernels.to_dense(_by_supplier(spark, sf), "l_suppkey", "at", "l_quantity", 8), "values").select("l_suppkey", "values")


def _by_supplier(spark, sf):
    return graphs.table(spark, sf, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("at"), "l_quantity")


@query("""WITH c AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS r FROM lineitem),
x AS (SELECT l_suppkey, list(l_quantity::BIGINT ORDER BY r) AS x FROM c GROUP BY l_suppkey), w AS (SELECT max(len(x)) AS w FROM x)
SELECT l_suppkey, array_to_string([CASE WHEN i <= len(x) THEN x[i] ELSE -1 END for i in range(1, w + 1)], ',') AS "values", len(x)::BIGINT AS n_real FROM x, w""")
def csr_to_dense(spark, sf):
    lines = _by_supplier(spark, sf)
    width = lines.groupBy("l_suppkey").count().agg(F.max("count")).first()[0] or 0
    out = kernels.to_dense(lines, "l_suppkey", "at", "l_quantity", width)
    return _strings(out.select("l_suppkey", "values", F.size(F.filter("mask", lambda x: x)).cast("long").alias("n_real")), "values")


def _scatter_sql(expr: str, empty: str) -> str:
    return f"""WITH {USER_NEXT}, n AS (SELECT max(dst) + 1 AS n FROM e), s AS (SELECT unnest(range(0, n + 5)) AS "index" FROM n),
g AS (SELECT dst AS "index", {expr} AS value FROM e GROUP BY dst) SELECT "index", {empty} AS value FROM s LEFT JOIN g USING ("index")"""


def _scatter(spark, sf, reduce: str, rows: DataFrame | None = None) -> DataFrame:
    edges = user_next(spark, sf).edges
    size = (edges.agg(F.max("dst")).first()[0] or -1) + 6
    return kernels.scatter(edges, "dst", "w", reduce, size)


@query(_scatter_sql("sum(w)::BIGINT", "coalesce(value, 0)"))
def scatter_sum(spark, sf):
    return _scatter(spark, sf, "sum")


@query(_scatter_sql("round(avg(w), 6)", "coalesce(value, 0)"))
def scatter_mean(spark, sf):
    return _rounded(_scatter(spark, sf, "mean"), "value")


@query(_scatter_sql("min(w)", "coalesce(value, -1)"))
def scatter_min(spark, sf):
    return _filled(_scatter(spark, sf, "min"), "value")


@query(_scatter_sql("max(w)", "coalesce(value, -1)"))
def scatter_max(spark, sf):
    return _filled(_scatter(spark, sf, "max"), "value")


@query("SELECT l_linenumber::BIGINT AS \"index\", round(exp(sum(ln(1 + l_tax / 100000))), 6) AS value FROM lineitem GROUP BY 1 UNION ALL SELECT 0, -1")
def scatter_mul(spark, sf):
    lines = graphs.table(spark, sf, "lineitem").select("l_linenumber", (1 + F.col("l_tax") / 100000).alias("x"))
    top = lines.agg(F.max("l_linenumber")).first()[0] or 0
    return _filled(_rounded(kernels.scatter(lines, "l_linenumber", "x", "mul", top + 1), "value"), "value")


@query(f"WITH {GEO_TREE}, d AS (SELECT dst AS id, sum(src) AS value FROM e GROUP BY dst) SELECT v.id, coalesce(value, 0)::BIGINT AS value FROM v LEFT JOIN d USING (id)")
def segment_sum(spark, sf):
    g = geo_tree(spark, sf)
    return kernels.segment_reduce(g.edges.select(F.col("dst").alias("id"), "src"), g.vertices, "id", "src", "sum")


@query(f"WITH {GEO_TREE}, d AS (SELECT dst AS id, min(src) AS value FROM e GROUP BY dst) SELECT v.id, coalesce(value, -1) AS value FROM v LEFT JOIN d USING (id)")
def segment_min(spark, sf):
    g = geo_tree(spark, sf)
    return _filled(kernels.segment_reduce(g.edges.select(F.col("dst").alias("id"), "src"), g.vertices, "id", "src", "min"), "value")


# Partitioners

RANGE_PART = "p AS (SELECT id, least(7, (row_number() OVER (ORDER BY id) - 1) // greatest(1, (SELECT count(*) FROM v) // 8))::INTEGER AS part FROM v)"
EBP_PART = """g AS (SELECT v.id, count(e.src) AS deg FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id),
b AS (SELECT id, deg, coalesce(sum(deg) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "begin" FROM g),
p AS (SELECT id, deg, least(7, "begin" // greatest(1, (SELECT count(*) FROM e) // 8))::INTEGER AS part FROM b)"""


@query(f"WITH {PART_CHAIN}, {RANGE_PART} SELECT id, part FROM p")
def partition_vertex_range(spark, sf):
    return partition.assign_parts(part_chain(spark, sf), 8, "range")


@query(f"WITH {PART_CHAIN}, {EBP_PART} SELECT id, part FROM p")
def partition_ebp(spark, sf):
    return partition.assign_parts(part_chain(spark, sf), 8, "ebp")


@query(f"WITH {PART_CHAIN}, {EBP_PART} SELECT part, count(*) AS n_vertices, sum(deg)::BIGINT AS n_edges FROM p GROUP BY part")
def partition_sizes(spark, sf):
    g = part_chain(spark, sf)
    return partition.part_sizes(g, partition.assign_parts(g, 8, "ebp"))


@query(f"WITH {PART_CHAIN}, {EBP_PART} SELECT s.part AS src_part, d.part AS dst_part, count(*) AS n_edges FROM e JOIN p s ON s.id = e.src JOIN p d ON d.id = e.dst GROUP BY 1, 2")
def partition_cut_matrix(spark, sf):
    g = part_chain(spark, sf)
    return partition.cut_matrix(g, partition.assign_parts(g, 8, "ebp"))


@query(f"""WITH {PART_CHAIN}, {EBP_PART},
c AS (SELECT s.part AS src_part, d.part AS dst_part, count(DISTINCT e.src) AS send_count FROM e JOIN p s ON s.id = e.src JOIN p d ON d.id = e.dst WHERE s.part <> d.part GROUP BY 1, 2)
SELECT src_part, dst_part, send_count,
  coalesce(sum(send_count) OVER (PARTITION BY src_part ORDER BY dst_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS send_offset,
  coalesce(sum(send_count) OVER (PARTITION BY dst_part ORDER BY src_part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS recv_offset,
  (sum(send_count) OVER (PARTITION BY dst_part))::BIGINT AS recv_total FROM c""")
def partition_exchange_plan(spark, sf):
    g = part_chain(spark, sf)
    return partition.exchange_plan(g, partition.assign_parts(g, 8, "ebp"))


def _greedy_sql(weight: str) -> str:
    """One vertex after another, the heaviest first, to the first part with the least load."""
    return f"""WITH RECURSIVE {PART_CHAIN}, g AS (SELECT v.id, count(e.src) AS deg FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id),
o AS MATERIALIZED (SELECT id, {weight} AS w, row_number() OVER (ORDER BY {weight} DESC, id) AS r FROM g),
x(r, id, part, loads) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::INTEGER, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT o.r, o.id, (list_position(loads, list_min(loads)) - 1)::INTEGER,
    list_transform(loads, lambda l, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN l + o.w ELSE l END) FROM x JOIN o ON o.r = x.r + 1)
SELECT id, part FROM x WHERE r > 0"""


@query(_greedy_sql("deg"))
def partition_greedy(spark, sf):
    return partition.assign_parts(part_chain(spark, sf), 8, "greedy")


@query(_greedy_sql("deg + 4"))
def partition_degree_alpha(spark, sf):
    return partition.assign_parts(part_chain(spark, sf), 8, "greedy_alpha", alpha=4)


# PageRank


def _pagerank_sql(rounds: int, damping: str, base: str, graph: str = PART_CHAIN, last: str = "id, round(r{0}.rank, 6) AS rank, round(abs(r{0}.rank - r{1}.rank), 6) AS delta FROM r{0} JOIN r{1} USING (id)") -> str:
    steps = ["r0 AS MATERIALIZED (SELECT v.id, 1.0::DOUBLE AS rank, c.n FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) c ON c.src = v.id)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT o.id, {base} + {damping}::DOUBLE * coalesce(s.x, 0) AS rank, o.n FROM r{i - 1} o
  LEFT JOIN (SELECT e.dst, sum(p.rank / p.n) AS x FROM e JOIN r{i - 1} p ON p.id = e.src GROUP BY e.dst) s ON s.dst = o.id)""")
    return f"WITH {graph}, " + ",\n".join(steps) + " SELECT " + last.format(rounds, rounds - 1)


@query(_pagerank_sql(10, "0.85", "(1 - 0.85)::DOUBLE"))
def pagerank_damped(spark, sf):
    return _rounded(pagerank(part_chain(spark, sf), 10), "rank", "delta")


@query(_pagerank_sql(10, "0.85", "(1 - 0.85)::DOUBLE / (SELECT count(*) FROM v)"))
def pagerank_1n(spark, sf):
    return _rounded(pagerank(part_chain(spark, sf), 10, teleport="1/n"), "rank", "delta")


@query(_pagerank_sql(10, "1.0", "0"))
def pagerank_undamped(spark, sf):
    return _rounded(pagerank(part_chain(spark, sf), 10, damping=1.0), "rank", "delta")


@query(_pagerank_sql(6, "0.85", "(1 - 0.85)::DOUBLE", GEO_TREE))
def pagerank_sinks(spark, sf):
    return _rounded(pagerank(geo_tree(spark, sf), 6), "rank", "delta")


@query(_pagerank_sql(10, "0.85", "(1 - 0.85)::DOUBLE", last="id, round(rank, 6) AS rank FROM r{0} ORDER BY round(rank, 6) DESC, id LIMIT 20"))
def pagerank_topk(spark, sf):
    return _rounded(pagerank(part_chain(spark, sf), 10), "rank").select("id", "rank").orderBy(F.desc("rank"), "id").limit(20)


def _pagerank_delta_sql(rounds: int, tol: str, graph: str) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT v.id, 1.0::DOUBLE AS rank, 0.0::DOUBLE AS delta, TRUE AS act, c.n FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) c ON c.src = v.id)"]
    for i in range(1, rounds + 1):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT o.id, o.rank AS old, o.delta AS old_delta, o.act, o.n, (1 - 0.85)::DOUBLE + 0.85::DOUBLE * coalesce(s.x, 0) AS new FROM r{i - 1} o
  LEFT JOIN (SELECT e.dst, sum(p.rank / p.n) AS x FROM e JOIN r{i - 1} p ON p.id = e.src GROUP BY e.dst) s ON s.dst = o.id),
r{i} AS MATERIALIZED (SELECT id, CASE WHEN act THEN new ELSE old END AS rank, CASE WHEN act THEN abs(new - old) ELSE old_delta END AS delta,
  id IN (SELECT e.dst FROM e JOIN m{i} x ON x.id = e.src WHERE x.act AND abs(x.new - x.old) > {tol}) AS act, n FROM m{i})""")
    return f"WITH {graph}, " + ",\n".join(steps) + f" SELECT id, round(rank, 6) AS rank, round(delta, 6) AS delta FROM r{rounds}"


@query(_pagerank_delta_sql(8, "0.001", PART_CHAIN))
def pagerank_delta(spark, sf):
    return _rounded(pagerank(part_chain(spark, sf), 8, tol=0.001), "rank", "delta")


@query(_pagerank_delta_sql(8, "0.01", USER_NEXT))
def pagerank_delta_partly_active(spark, sf):
    return _rounded(pagerank(user_next(spark, sf), 8, tol=0.01), "rank", "delta")


# Searches

# Unreached vertices, null in the results, are -1 here, so that all rows have a number.
BFS_TAIL = "SELECT v.id, coalesce(r.d, -1)::INTEGER AS dist FROM v LEFT JOIN r USING (id)"


def _bfs_sql(graph: str, sources: str, tail: str = BFS_TAIL, edges: str = "e") -> str:
    return f"""WITH RECURSIVE {graph}, x AS (SELECT src, dst FROM {edges}),
r(id, d) USING KEY (id) AS (SELECT id, 0 FROM v WHERE id IN ({sources})
  UNION (SELECT DISTINCT x.dst, r.d + 1 FROM r JOIN x ON r.id = x.src ANTI JOIN recurring.r k ON k.id = x.dst)) {tail}"""


@query(_bfs_sql(PART_CHAIN, "0"))
def bfs_levels(spark, sf):
    return _filled(bfs(part_chain(spark, sf), [0]), "dist")


@query(_bfs_sql(PART_CHAIN, "0"))
def bfs_blocks(spark, sf):
    return _filled(bfs_in_blocks(part_chain(spark, sf), [0]), "dist")


@query(_bfs_sql(PART_CHAIN, "0", "SELECT d::INTEGER AS dist, count(*) AS n FROM r GROUP BY d"))
def bfs_level_histogram(spark, sf):
    return bfs(part_chain(spark, sf), [0]).filter("dist is not null").groupBy("dist").agg(F.count("*").alias("n"))


@query(_bfs_sql(CUST_PART, "0, 1, 3, 8"))
def bfs_multi_source(spark, sf):
    return _filled(bfs(cust_part(spark, sf), [0, 1, 3, 8]), "dist")


@query(_bfs_sql(PART_CHAIN, "0", edges="(SELECT dst AS src, src AS dst FROM e)"))
def bfs_reverse(spark, sf):
    return _filled(bfs(part_chain(spark, sf), [0], direction="in"), "dist")


@query(_bfs_sql(CUST_PART, "0", "SELECT max(r.d)::INTEGER AS max_dist, count(r.d) AS reachable, count(*) - count(r.d) AS unvisited FROM v LEFT JOIN r USING (id)"))
def bfs_summary(spark, sf):
    return summary(bfs(cust_part(spark, sf), [0]))


def _sssp_sql(weight: str, tail: str = "SELECT v.id, coalesce(r.d, -1)::BIGINT AS dist FROM v LEFT JOIN r USING (id)") -> str:
    return f"""WITH RECURSIVE {USER_NEXT},
r(id, d) USING KEY (id) AS (SELECT id, 0::BIGINT FROM v WHERE id = 0
  UNION (SELECT e.dst, min(r.d + {weight}) FROM r JOIN e ON r.id = e.src LEFT JOIN recurring.r k ON k.id = e.dst WHERE k.id IS NULL OR r.d + {weight} < k.d GROUP BY 1)) {tail}"""


@query(_sssp_sql("e.w"))
def sssp_weighted(spark, sf):
    return _filled(sssp(user_next(spark, sf), 0, "w"), "dist")


@query(_sssp_sql("1"))
def sssp_unit(spark, sf):
    return _filled(sssp(user_next(spark, sf), 0), "dist")


@query(_sssp_sql("e.w", "SELECT max(r.d)::BIGINT AS max_dist, count(r.d) AS reachable, count(*) - count(r.d) AS unvisited FROM v LEFT JOIN r USING (id)"))
def sssp_summary(spark, sf):
    return summary(sssp(user_next(spark, sf), 0, "w"))


# Components


def _wcc_sql(tail: str) -> str:
    return f"""WITH RECURSIVE {CUST_PART},
r(id, l) USING KEY (id) AS (SELECT id, id FROM v
  UNION (SELECT e.dst, min(r.l) FROM r JOIN e ON r.id = e.src JOIN recurring.r k ON k.id = e.dst WHERE r.l < k.l GROUP BY 1)) {tail}"""


@query(_wcc_sql("SELECT id, l AS label FROM r"))
def wcc_labels(spark, sf):
    return wcc(cust_part(spark, sf), method="labels")


def _wcc_capped_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, id AS l FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT o.id, least(o.l, coalesce(m.l, o.l)) AS l FROM r{i - 1} o LEFT JOIN (SELECT e.dst AS id, min(p.l) AS l FROM e JOIN r{i - 1} p ON p.id = e.src GROUP BY 1) m USING (id))")
    return f"WITH {CUST_PART}, " + ",\n".join(steps) + f" SELECT id, l AS label FROM r{rounds}"


@query(_wcc_capped_sql(3))
def wcc_capped(spark, sf):
    return wcc(cust_part(spark, sf), max_iter=3)


@query(_wcc_sql("SELECT id, l AS label FROM r"))
def wcc_stars(spark, sf):
    return wcc(cust_part(spark, sf))


@query(_wcc_sql("SELECT l AS label, count(*) AS n FROM r GROUP BY l"))
def wcc_component_sizes(spark, sf):
    return wcc(cust_part(spark, sf)).groupBy("label").agg(F.count("*").alias("n"))


@query(_wcc_sql("SELECT count(DISTINCT l) AS components FROM r"))
def wcc_count(spark, sf):
    return kernels.count_distinct(wcc(cust_part(spark, sf)), "label", "components")


# HITS


def _hits_sql(rounds: int, tail: str) -> str:
    steps = ["s0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS h, 1.0::DOUBLE / (SELECT count(*) FROM v) AS a, 0.0::DOUBLE AS dh, 0.0::DOUBLE AS da FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"""u{i} AS MATERIALIZED (SELECT o.id, o.h AS oh, o.a AS oa, coalesce(x.x, 0)::DOUBLE AS h, coalesce(y.y, 0)::DOUBLE AS a FROM s{i - 1} o
  LEFT JOIN (SELECT e.src AS id, sum(p.a) AS x FROM e JOIN s{i - 1} p ON p.id = e.dst GROUP BY 1) x USING (id)
  LEFT JOIN (SELECT e.dst AS id, sum(p.h) AS y FROM e JOIN s{i - 1} p ON p.id = e.src GROUP BY 1) y USING (id)),
n{i} AS MATERIALIZED (SELECT sqrt(sum(h * h)) AS h, sqrt(sum(a * a)) AS a FROM u{i}),
s{i} AS MATERIALIZED (SELECT u.id, u.h / n.h AS h, u.a / n.a AS a, abs(u.h / n.h - u.oh) AS dh, abs(u.a / n.a - u.oa) AS da FROM u{i} u, n{i} n)""")
    return f"WITH {PART_CHAIN}, " + ",\n".join(steps) + " " + tail.format(rounds)


@query(_hits_sql(5, "SELECT id, round(h, 6) AS hub, round(a, 6) AS authority, round(dh, 6) AS delta_hub, round(da, 6) AS delta_authority FROM s{0}"))
def hits_values(spark, sf):
    return _rounded(hits(part_chain(spark, sf), 5), "hub", "authority", "delta_hub", "delta_authority")


@query(_hits_sql(5, "SELECT id, round(h, 6) AS hub FROM s{0} ORDER BY round(h, 6) DESC, id LIMIT 10"))
def hits_top_hubs(spark, sf):
    return _rounded(hits(part_chain(spark, sf), 5), "hub").select("id", "hub").orderBy(F.desc("hub"), "id").limit(10)


def _hits_active_sql(rounds: int, tol: float) -> str:
    steps = ["s0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS h, 1.0::DOUBLE / (SELECT count(*) FROM v) AS a, 0.0::DOUBLE AS dh, 0.0::DOUBLE AS da, TRUE AS act FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"""u{i} AS MATERIALIZED (SELECT o.id, o.act, o.h AS oh, o.a AS oa, o.dh, o.da, CASE WHEN o.act THEN coalesce(x.x, 0)::DOUBLE ELSE o.h END AS h, CASE WHEN o.act THEN coalesce(y.y, 0)::DOUBLE ELSE o.a END AS a FROM s{i - 1} o
  LEFT JOIN (SELECT e.src AS id, sum(p.a) AS x FROM e JOIN s{i - 1} p ON p.id = e.dst GROUP BY 1) x USING (id)
  LEFT JOIN (SELECT e.dst AS id, sum(p.h) AS y FROM e JOIN s{i - 1} p ON p.id = e.src GROUP BY 1) y USING (id)),
n{i} AS MATERIALIZED (SELECT sqrt(sum(h * h)) AS h, sqrt(sum(a * a)) AS a FROM u{i}),
t{i} AS MATERIALIZED (SELECT u.id, u.act, CASE WHEN act THEN u.h / n.h ELSE u.h END AS h, CASE WHEN act THEN u.a / n.a ELSE u.a END AS a,
  CASE WHEN act THEN abs(u.h / n.h - u.oh) ELSE u.dh END AS dh, CASE WHEN act THEN abs(u.a / n.a - u.oa) ELSE u.da END AS da FROM u{i} u, n{i} n),
s{i} AS MATERIALIZED (SELECT id, h, a, dh, da, id IN (SELECT e.dst FROM e JOIN t{i} x ON x.id = e.src WHERE x.act AND (x.dh > {tol} OR x.da > {tol})
  UNION ALL SELECT e.src FROM e JOIN t{i} x ON x.id = e.dst WHERE x.act AND (x.dh > {tol} OR x.da > {tol})) AS act FROM t{i})""")
    return f"WITH {USER_NEXT}, " + ",\n".join(steps) + f" SELECT id, round(h, 6) AS hub, round(a, 6) AS authority, round(dh, 6) AS delta_hub, round(da, 6) AS delta_authority FROM s{rounds}"


@query(_hits_active_sql(6, 0.002))
def hits_partly_active(spark, sf):
    return _rounded(hits(user_next(spark, sf), 6, tol=0.002), "hub", "authority", "delta_hub", "delta_authority")


# Programs by name


@query(_bfs_sql(PART_CHAIN, "0"))
def named_bfs(spark, sf):
    return _filled(get_program("BFS", sources=[0])(part_chain(spark, sf)), "dist")


@query(_pagerank_sql(5, "0.85", "(1 - 0.85)::DOUBLE / (SELECT count(*) FROM v)"))
def named_pagerank(spark, sf):
    return _rounded(get_program("PageRank", max_iter=5)(part_chain(spark, sf)), "rank", "delta")


@query(_sssp_sql("1"))
def named_sssp(spark, sf):
    return _filled(get_program("SSSP", source=0)(user_next(spark, sf)), "dist")


@query(_wcc_sql("SELECT id, l AS label FROM r"))
def named_components(spark, sf):
    return get_program("ConnectedComponents")(cust_part(spark, sf))


@query(_hits_sql(3, "SELECT id, round(h, 6) AS hub, round(a, 6) AS authority, round(dh, 6) AS delta_hub, round(da, 6) AS delta_authority FROM s{0}"))
def named_hits(spark, sf):
    return _rounded(get_program("HITS", max_iter=3)(part_chain(spark, sf)), "hub", "authority", "delta_hub", "delta_authority")


# Programs of one's own


@query(f"""WITH RECURSIVE {CUST_PART},
r(id, l) USING KEY (id) AS (SELECT id, id FROM v
  UNION (SELECT e.dst, max(r.l) FROM r JOIN e ON r.id = e.src JOIN recurring.r k ON k.id = e.dst WHERE r.l > k.l GROUP BY 1)) SELECT id, l AS label FROM r""")
def gas_custom_max_label(spark, sf):
    p = VertexProgram(init={"label": F.col("id")}, message=F.col("from_label"), combine="max", apply={"label": F.greatest("label", "msg")})
    return p.run(cust_part(spark, sf)).vertices


@query(f"WITH {CUST_PART}, d AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst) SELECT v.id, round(coalesce(n, 0)::DOUBLE / ((SELECT count(*) FROM v) - 1), 6) AS centrality FROM v LEFT JOIN d USING (id)")
def gas_degree_centrality(spark, sf):
    g = cust_part(spark, sf)
    share = F.coalesce("msg", F.lit(0.0)) / (g.num_vertices() - 1)
    p = VertexProgram(init={"centrality": F.lit(0.0)}, message=F.lit(1.0), combine="sum", apply={"centrality": share}, active="all", max_iter=1, fixed=True)
    return _rounded(p.run(g).vertices, "centrality")


@query(f"""WITH {USER_NEXT}, s AS (SELECT v.id, coalesce(min(e.w), 0) AS x FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id)
SELECT e.eid, e.src, e.dst, e.w - s.x AS w FROM e JOIN s ON s.id = e.dst""")
def gas_edge_update(spark, sf):
    p = VertexProgram(
        init={"x": F.lit(0).cast("long")}, message=F.col("w"), combine="min", apply={"x": F.coalesce("msg", F.lit(0).cast("long"))}, active="all", max_iter=1, fixed=True,
        edge_update={"w": F.col("w") - F.col("dst_x")},
    )
    return p.run(user_next(spark, sf, ids=True)).edges.select("eid", "src", "dst", "w")


def _scatter_rounds_sql(rounds: int) -> str:
    """A vertex takes the least sum of a neighbour's value and the edge's weight; then each edge takes on the difference of its ends."""
    steps = ["s0 AS (SELECT id, (id % 7)::BIGINT AS x FROM v)", "e_0 AS (SELECT eid, src, dst, w FROM e)"]
    for i in range(1, rounds + 1):
        steps.append(f"s{i} AS MATERIALIZED (SELECT o.id, coalesce(m.m, o.x) AS x FROM s{i - 1} o LEFT JOIN (SELECT e.dst AS id, min(p.x + e.w) AS m FROM e_{i - 1} e JOIN s{i - 1} p ON p.id = e.src GROUP BY 1) m USING (id))")
        steps.append(f"e_{i} AS MATERIALIZED (SELECT e.eid, e.src, e.dst, abs(e.w - a.x + b.x) % 1000 AS w FROM e_{i - 1} e JOIN s{i} a ON a.id = e.src JOIN s{i} b ON b.id = e.dst)")
    return f"WITH {USER_NEXT}, " + ",\n".join(steps)


def _scatter_program(spark, sf):
    p = VertexProgram(
        init={"x": F.col("id") % 7}, message=F.col("from_x") + F.col("w"), combine="min", apply={"x": F.coalesce("msg", "x")}, active="all", max_iter=4, fixed=True,
        edge_update={"w": F.abs(F.col("w") - F.col("src_x") + F.col("dst_x")) % 1000},
    )
    return p.run(user_next(spark, sf, ids=True))


@query(_scatter_rounds_sql(4) + " SELECT id, x FROM s4")
def gas_scatter_each_round(spark, sf):
    return _scatter_program(spark, sf).vertices


@query(_scatter_rounds_sql(4) + " SELECT eid, src, dst, w FROM e_4")
def gas_scatter_edges(spark, sf):
    return _scatter_program(spark, sf).edges.select("eid", "src", "dst", "w")


def _activation_sql(rounds: int) -> str:
    """Active vertices count the neighbours whose edges lead to them; those that changed wake who leads to
    them, multiples of 5 stay awake, and after the second round the active ones stay for one more."""
    steps = ["r0 AS (SELECT id, 1::BIGINT AS x, id % 3 = 0 AS act FROM v)"]
    for i in range(1, rounds + 1):
        steps.append(f"""m{i} AS MATERIALIZED (SELECT o.id, o.act, CASE WHEN o.act THEN coalesce(s.x, 0) % 101 ELSE o.x END AS x, o.act AND o.x <> coalesce(s.x, 0) % 101 AS ch FROM r{i - 1} o
  LEFT JOIN (SELECT e.dst AS id, sum(p.x)::BIGINT AS x FROM e JOIN r{i - 1} p ON p.id = e.src GROUP BY 1) s USING (id))""")
        act = "act" if i == 2 else f"(id % 5 = 0 OR id IN (SELECT e.src FROM e JOIN m{i} y ON y.id = e.dst WHERE y.ch))"
        steps.append(f"r{i} AS MATERIALIZED (SELECT id, x, {act} AS act FROM m{i})")
    return f"WITH {GEO_TREE}, " + ",\n".join(steps) + f" SELECT id, x FROM r{rounds}"


@query(_activation_sql(4))
def gas_activation(spark, sf):
    p = VertexProgram(
        init={"x": F.lit(1).cast("long")}, message=F.col("from_x"), combine="sum", apply={"x": F.coalesce("msg", F.lit(0)) % 101}, active="gather", start=F.col("id") % 3 == 0,
        direction="out", scatter="in", activate=F.col("id") % 5 == 0, hold=lambda r: r == 2, max_iter=4, fixed=True,
    )
    return p.run(geo_tree(spark, sf)).vertices


@query(f"WITH {PART_CHAIN}, c AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src), m AS (SELECT e.dst AS id, round(sum(1.0::DOUBLE / c.n), 6) AS x FROM e JOIN c ON c.id = e.src WHERE c.n > 20 GROUP BY 1) SELECT v.id, coalesce(m.x, 0) AS x FROM v LEFT JOIN m USING (id)")
def gas_prepared_context(spark, sf):
    """Degrees are added to the vertices first; only senders with more than 20 edges send."""

    def prepare(g):
        return g.vertices.join(g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left")

    p = VertexProgram(
        init={"x": F.lit(0.0), "n": F.col("n")}, message=1.0 / F.col("from_n"), combine="sum", apply={"x": F.coalesce("msg", F.lit(0.0))},
        active="all", max_iter=1, fixed=True, prepare=prepare, frontier=F.col("n") > 20,
    )
    return _rounded(p.run(part_chain(spark, sf)).vertices.select("id", "x"), "x")


@query(f"WITH {PART_CHAIN} SELECT 4::INTEGER AS iterations, FALSE AS converged")
def program_metrics(spark, sf):
    return pagerank_run(part_chain(spark, sf), max_iter=4).summary().select("iterations", "converged")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) AS place FROM orders")
def dense_index(spark, sf):
    return prefix.dense_index(graphs.table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


from vertexloom import source_queries  # noqa: E402, F401  registers its queries here
