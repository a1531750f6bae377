"""Queries that write a derived graph to files and read it back, and that go through the command line.

Each has the SQL of the graph itself, so what is compared went through a writer and a reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom import cli
from vertexloom.algorithms import bfs, hits, pagerank, sssp, wcc
from vertexloom.graphs import CUST_PART, GEO_TREE, PART_CHAIN, USER_NEXT, cust_part, geo_tree, part_chain, table, user_next
from vertexloom.model import Graph
from vertexloom.operators import etl, partition
from vertexloom.plans.workspace import Workspace
from vertexloom.queries import EBP_PART, _bfs_sql, _filled, _hits_sql, _pagerank_sql, _rounded, _sssp_sql, _wcc_sql, query
from vertexloom.sources import csrbin, synthetic, text


def _folder(spark: SparkSession) -> str:
    return Workspace(spark, "files").folder


def _csr_files(spark: SparkSession, sf: str, long: bool = True, csc: bool = False) -> str:
    path = _folder(spark)
    csrbin.write_csr(part_chain(spark, sf), path, long, csc=csc)
    return path


# CSR and CSC files


@query(f"WITH {PART_CHAIN} SELECT eid, src, dst FROM e")
def csr_read(spark, sf):
    return Graph.read_csr(spark, _csr_files(spark, sf)).edges


@query(f"WITH {PART_CHAIN} SELECT eid, src, dst FROM e")
def csr_read_int32(spark, sf):
    return csrbin.read_edges(spark, _csr_files(spark, sf, long=False), long=False, edges_per_task=1000)


@query("SELECT p_partkey AS id FROM part")
def csr_read_vertices(spark, sf):
    return Graph.read_csr(spark, _csr_files(spark, sf), long=True).vertices


DENSE_USERS = f"WITH {USER_NEXT}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v), f AS (SELECT s.i AS src, d.i AS dst, e.w::DOUBLE AS w FROM e JOIN m s ON s.id = e.src JOIN m d ON d.id = e.dst)"


def _dense_users(spark: SparkSession, sf: str) -> Graph:
    g = user_next(spark, sf)
    return Graph(*etl.renumber(g.vertices, g.edges))


@query(f"{DENSE_USERS} SELECT src, dst, w FROM f")
def csr_read_weighted(spark, sf):
    path = _folder(spark)
    csrbin.write_csr(_dense_users(spark, sf), path, weight="w")
    return csrbin.read_edges(spark, path, weighted=True).select("src", "dst", "w")


@query(f"WITH {PART_CHAIN} SELECT row_number() OVER (ORDER BY dst, src) - 1 AS pos, src, dst FROM e")
def csc_read(spark, sf):
    return csrbin.read_csc(spark, _csr_files(spark, sf, csc=True))


@query(f"WITH {PART_CHAIN} SELECT row_number() OVER (ORDER BY dst, src) - 1 AS pos, eid FROM e")
def csc_read_edge_map(spark, sf):
    path = _csr_files(spark, sf, long=False, csc=True)
    return csrbin.read_csc_map(spark, csrbin.read_edges(spark, path), path)


@query(f"""WITH {PART_CHAIN}, {EBP_PART},
b2 AS (SELECT id, part, coalesce(sum(deg) OVER (PARTITION BY part ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "begin" FROM p)
SELECT part, b2.id, "begin", eid, dst AS nbr FROM b2 JOIN e ON e.src = b2.id""")
def csr_read_in_parts(spark, sf):
    g = Graph.read_csr(spark, _csr_files(spark, sf))
    return partition.part_edges(g, partition.assign_parts(g, 8, "ebp"))


# Text files


@query(f"WITH {GEO_TREE}, m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v), f AS (SELECT s.i AS src, d.i AS dst FROM e JOIN m s ON s.id = e.src JOIN m d ON d.id = e.dst) SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst FROM f")
def csrc_text_read(spark, sf):
    g, path = geo_tree(spark, sf), _folder(spark)
    text.write_csrc(Graph(*etl.renumber(g.vertices, g.edges)), path)
    return Graph.read_csrc_text(spark, path).edges


@query(f"WITH {PART_CHAIN} SELECT eid, src, dst FROM e")
def csr_text_read(spark, sf):
    path = _folder(spark)
    text.write_csrc(part_chain(spark, sf), path)
    return text.read_csrc(spark, path, csr_only=True)[1]


def _edge_lines(edges: DataFrame, spark: SparkSession) -> str:
    path = _folder(spark)
    edges.select(F.concat_ws(" ", *edges.columns).alias("value")).write.text(path)
    return path


@query(f"WITH {USER_NEXT} SELECT src, dst, w::DOUBLE AS w FROM e")
def edgelist_read(spark, sf):
    return text.read_edgelist(spark, _edge_lines(user_next(spark, sf).edges.select("src", "dst", "w"), spark), attrs=("w",))


@query(f"WITH {USER_NEXT}, b AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e), u AS (SELECT src, dst, min(w)::DOUBLE AS w FROM b GROUP BY src, dst) SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, w FROM u")
def edgelist_graph_undirected(spark, sf):
    path = _edge_lines(user_next(spark, sf).edges.select("src", "dst", "w"), spark)
    return Graph.read_edgelist(spark, path, attrs=("w",)).edges


@query("SELECT row_number() OVER (ORDER BY l_suppkey, l_linenumber) - 1 AS eid, l_suppkey AS src, l_linenumber::BIGINT AS dst FROM lineitem")
def edgelist_graph_directed(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("dst"))
    return Graph.read_edgelist(spark, _edge_lines(lines, spark), sep=" ", directed=True).edges


@query(f"WITH {PART_CHAIN} SELECT dst AS id, src AS nbr, eid, 'in' AS dir FROM e")
def edgelist_graph_by_destination(spark, sf):
    return Graph.read_edgelist(spark, _edge_lines(part_chain(spark, sf).edges, spark), directed=True).neighbors(mode="in")


CONVERTED = """WITH r AS (SELECT l_suppkey AS src, l_linenumber::BIGINT AS dst FROM lineitem), k AS (SELECT * FROM r WHERE src <> dst),
u AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k)
SELECT (SELECT count(DISTINCT src) FROM u) AS vertices, (SELECT count(*) FROM u) AS edges, (SELECT count(*) FROM r WHERE src = dst) AS loops,
  2 * (SELECT count(*) FROM k) - (SELECT count(*) FROM u) AS duplicates"""


@query(CONVERTED)
def convert_edgelist(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_linenumber").alias("dst"))
    return _cli(spark, "convert", "--input", _edge_lines(lines, spark), "--output", _folder(spark), "--long")


PRESETS = " UNION ALL ".join(f"SELECT '{n}' AS preset, {v}::BIGINT AS vertices, {e}::BIGINT AS edges, 0::BIGINT AS loops, 0::BIGINT AS duplicates, {2 * (v - 1)}::BIGINT AS chain" for n, (v, e) in synthetic.PRESETS.items())


@query(PRESETS)
def synthetic_graphs(spark, sf):
    out = None
    for name in synthetic.PRESETS:
        g = synthetic.preset(spark, name)
        e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), (F.count("*") - F.count_distinct("src", "dst")).alias("duplicates"), F.count_if(F.abs(F.col("src") - F.col("dst")) == 1).alias("near"))
        links = g.edges.filter("abs(src - dst) = 1").agg(F.count_distinct("src", "dst").alias("chain"))
        row = g.vertices.agg(F.count("*").alias("vertices")).join(F.broadcast(e)).join(F.broadcast(links)).select(F.lit(name).alias("preset"), "vertices", "edges", "loops", "duplicates", "chain")
        out = row if out is None else out.unionByName(row)
    return out


# Results in the order of vertices


def _lines(spark: SparkSession, vertices: DataFrame, *columns: str) -> DataFrame:
    """(line, value): what a single file of results holds, line by line."""
    path = _folder(spark)
    text.write_values(vertices, list(columns), path, single_file=True)
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line", "value"))
    return whole.select(F.col("line").cast("long"), "value")


@query(_bfs_sql(CUST_PART, "0", "SELECT row_number() OVER (ORDER BY v.id) - 1 AS line, coalesce(r.d::VARCHAR, '') AS value FROM v LEFT JOIN r USING (id)"))
def values_bfs(spark, sf):
    return _lines(spark, bfs(cust_part(spark, sf), [0]), "dist")


@query(_sssp_sql("e.w", "SELECT row_number() OVER (ORDER BY v.id) - 1 AS line, coalesce(r.d::VARCHAR, '') AS value FROM v LEFT JOIN r USING (id)"))
def values_sssp(spark, sf):
    return _lines(spark, sssp(user_next(spark, sf), 0, "w"), "dist")


@query(_wcc_sql("SELECT row_number() OVER (ORDER BY id) - 1 AS line, l::VARCHAR AS value FROM r"))
def values_wcc(spark, sf):
    return _lines(spark, wcc(cust_part(spark, sf)), "label")


@query(_hits_sql(5, "SELECT row_number() OVER (ORDER BY id) - 1 AS line, round(h, 6) AS hub, round(a, 6) AS authority FROM s{0}"))
def values_hits(spark, sf):
    lines = _lines(spark, hits(part_chain(spark, sf), 5), "hub", "authority")
    return lines.select("line", *[F.round(F.split("value", "\t")[i].cast("double"), 6).alias(c) for i, c in enumerate(("hub", "authority"))])


@query(_pagerank_sql(10, "0.85", "(1 - 0.85)::DOUBLE", last="row_number() OVER (ORDER BY id) - 1 AS line, round(rank, 6) AS rank FROM r{0}"))
def values_pagerank(spark, sf):
    return _lines(spark, pagerank(part_chain(spark, sf), 10), "rank").select("line", F.round(F.col("value").cast("double"), 6).alias("rank"))


# Command line


def _cli(spark: SparkSession, *argv: str) -> DataFrame:
    return cli.run(spark, cli.parser().parse_args(["-a", *argv]))


@query(_pagerank_sql(10, "0.85", "(1 - 0.85)::DOUBLE", last="id, round(rank, 6) AS rank FROM r{0}"))
def cli_pagerank(spark, sf):
    out = _folder(spark)
    return _rounded(_cli(spark, "pr", "--input", _csr_files(spark, sf), "--output", out, "-n", "10", "--directed"), "rank").select("id", "rank")


@query(_bfs_sql(PART_CHAIN, "0"))
def cli_bfs(spark, sf):
    return _filled(_cli(spark, "bfs", "--input", _csr_files(spark, sf), "--directed", "--source", "0", "--push-pull"), "dist")


DENSE_SSSP = f"""WITH RECURSIVE {DENSE_USERS.removeprefix("WITH ")},
r(id, d) USING KEY (id) AS (SELECT i, 0::DOUBLE FROM m WHERE i = 0
  UNION (SELECT f.dst, min(r.d + f.w) FROM r JOIN f ON r.id = f.src LEFT JOIN recurring.r k ON k.id = f.dst WHERE k.id IS NULL OR r.d + f.w < k.d GROUP BY 1))
SELECT m.i AS id, coalesce(r.d, -1) AS dist FROM m LEFT JOIN r ON r.id = m.i"""


@query(DENSE_SSSP)
def cli_sssp(spark, sf):
    path = _folder(spark)
    csrbin.write_csr(_dense_users(spark, sf), path, weight="w")
    return _filled(_cli(spark, "sssp", "--input", path, "--directed", "--weight", "w"), "dist")


@query(_wcc_sql("SELECT id, l AS label FROM r"))
def cli_wcc(spark, sf):
    g, path = cust_part(spark, sf), _folder(spark)
    g.edges.select("src", "dst").write.parquet(path)
    found = _cli(spark, "wcc", "--input", path, "--format", "parquet", "--partitions", "8")
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


@query(_hits_sql(5, "SELECT id, round(h, 6) AS hub, round(a, 6) AS authority FROM s{0}"))
def cli_hits(spark, sf):
    found = _cli(spark, "hits", "--input", _csr_files(spark, sf, long=False), "--directed", "-n", "5")
    return _rounded(found.select("id", "hub", "authority"), "hub", "authority")


@query("SELECT 100::BIGINT AS vertices, 500::BIGINT AS edges, 0::BIGINT AS loops, 0::BIGINT AS duplicates")
def cli_generate(spark, sf):
    return _cli(spark, "generate", "--output", _folder(spark), "--preset", "small", "--seed", "42")

