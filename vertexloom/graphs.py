"""Graphs that are derived from relational tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vertexloom.functions import prefix
from vertexloom.model import Graph
from vertexloom.operators import etl

#: Apart, so that ids of several tables never meet.
NATION, SUPPLIER, CUSTOMER = 1_000, 1_000_000, 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(vertices: DataFrame, edges: DataFrame, ids: bool, directed: bool = True) -> Graph:
    return Graph(vertices, etl.with_edge_ids(edges) if ids else edges, directed)


def part_chain(spark: SparkSession, sf_dir: str, ids: bool = False) -> Graph:
    """Parts that follow each other in an order; directed."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    edges = pairs.filter("dst is not null and src <> dst").distinct()
    return _graph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges, ids)


PART_CHAIN = """e0 AS (SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst FROM e0),
v AS (SELECT p_partkey AS id FROM part)"""


def raw_cust_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even ids) and the parts (odd ids) that they ordered 50 or more of, repeats and all."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"))


def cust_part(spark: SparkSession, sf_dir: str, ids: bool = False) -> Graph:
    """The same without repeats and in both directions, with all customers and parts as vertices."""
    edges = etl.symmetrize(raw_cust_part(spark, sf_dir).distinct())
    customers = table(spark, sf_dir, "customer").select((2 * F.col("c_custkey")).alias("id"))
    parts = table(spark, sf_dir, "part").select((2 * F.col("p_partkey") + 1).alias("id"))
    return _graph(customers.union(parts), edges, ids, directed=False)


CUST_PART = """h AS (SELECT 2 * o_custkey AS src, 2 * l_partkey + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50),
e0 AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst FROM e0),
v AS (SELECT 2 * c_custkey AS id FROM customer UNION ALL SELECT 2 * p_partkey + 1 FROM part)"""


def user_next(spark: SparkSession, sf_dir: str, ids: bool = False) -> Graph:
    """Users whose events follow each other, weighted by the least value in cents; directed."""
    events = table(spark, sf_dir, "events").filter("user_id is not null").select("ts", "event_id", "user_id", "value")
    pairs = prefix.following(events, ["ts", "event_id"], "user_id", "dst")
    pairs = pairs.select(F.col("user_id").alias("src"), "dst", F.round(F.col("value") * 100).cast("long").alias("w"))
    edges = pairs.filter("dst is not null and src <> dst and w is not null").groupBy("src", "dst").agg(F.min("w").alias("w"))
    return _graph(events.select(F.col("user_id").alias("id")).distinct(), edges, ids)


USER_NEXT = """e0 AS (SELECT src, dst, min(w) AS w FROM (
    SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, CAST(round(value * 100) AS BIGINT) AS w
    FROM events WHERE user_id IS NOT NULL)
  WHERE dst IS NOT NULL AND src <> dst AND w IS NOT NULL GROUP BY src, dst),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst, w) - 1 AS eid, src, dst, w FROM e0),
v AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL)"""


def geo_tree(spark: SparkSession, sf_dir: str, ids: bool = False) -> Graph:
    """Suppliers and customers to nations, nations to regions; directed, regions are sinks."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda c, shift=0: F.col(c).cast("long") + F.lit(shift).cast("long")
    edges = t("nation").select(key("n_nationkey", NATION).alias("src"), key("n_regionkey").alias("dst"))
    edges = edges.union(t("supplier").select(key("s_suppkey", SUPPLIER), key("s_nationkey", NATION)))
    edges = edges.union(t("customer").select(key("c_custkey", CUSTOMER), key("c_nationkey", NATION)))
    vertices = t("region").select(key("r_regionkey").alias("id")).union(t("nation").select(key("n_nationkey", NATION)))
    vertices = vertices.union(t("supplier").select(key("s_suppkey", SUPPLIER))).union(t("customer").select(key("c_custkey", CUSTOMER)))
    return _graph(vertices, edges, ids)


GEO_TREE = f"""e0 AS (SELECT n_nationkey::BIGINT + {NATION} AS src, n_regionkey::BIGINT AS dst FROM nation
  UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey::BIGINT + {NATION} FROM supplier UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey::BIGINT + {NATION} FROM customer),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst FROM e0),
v AS (SELECT r_regionkey::BIGINT AS id FROM region UNION ALL SELECT n_nationkey::BIGINT + {NATION} FROM nation
  UNION ALL SELECT s_suppkey + {SUPPLIER} FROM supplier UNION ALL SELECT c_custkey + {CUSTOMER} FROM customer)"""
