"""Construction of graphs: loops, symmetry, duplicates, numbering, transposition, offsets, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import prefix


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def transpose(edges: DataFrame) -> DataFrame:
    """Source and destination swapped; all other columns, the edge id included, stay with their edge."""
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def symmetrize(edges: DataFrame) -> DataFrame:
    return edges.unionByName(transpose(edges))


def dedupe(edges: DataFrame) -> DataFrame:
    """One edge for each source and destination, with the least of each attribute."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in rest]) if rest else edges.distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct ends of all edges."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Edge ids: the place of an edge in the order of source, destination and then its attributes."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return prefix.dense_index(edges, ["src", "dst", *rest], "eid").select("eid", "src", "dst", *rest)


def numbering(vertices: DataFrame) -> DataFrame:
    """(id, index): the vertices' places in the order of ids."""
    return prefix.dense_index(vertices.select("id").distinct(), ["id"], "index")


def renumber(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dense ids from 0 in the order of the old ones, which stay as ``old_id`` of the vertices."""
    to = numbering(vertices)
    v = vertices.join(to, "id").withColumnRenamed("id", "old_id").withColumnRenamed("index", "id")
    v = v.select("id", "old_id", *[c for c in vertices.columns if c != "id"])
    s, d = (to.select(F.col("id").alias(c), F.col("index").alias(f"_{c}")) for c in ("src", "dst"))
    e = edges.join(s, "src").join(d, "dst")
    return v, e.select(*[F.col(f"_{c}").alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])


def offsets(vertices: DataFrame, edges: DataFrame, by: str = "src") -> DataFrame:
    """(id, begin, degree): where each vertex's edges begin in the order of ``by``; zero degrees too."""
    degree = edges.groupBy(F.col(by).alias("id")).agg(F.count("*").alias("degree"))
    all_ = vertices.select("id").join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return prefix.running(all_, ["id"], F.col("degree"), "begin").select("id", "begin", "degree")


def csc_positions(edges: DataFrame) -> DataFrame:
    """(pos, eid): the edge at each place of the order by destination, source and edge id."""
    return prefix.dense_index(edges.select("dst", "src", "eid"), ["dst", "src", "eid"], "pos").select("pos", "eid")


def counting_sort(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Add ``rank``, the place of each row in the order of ``key``, then ``tie``."""
    return prefix.dense_index(rows, [key, tie], "rank")


def violations(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id): edges whose ends are no vertices, repeated ids, and null ids; empty if all is well."""
    ids = vertices.select("id").distinct()
    out = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").select(F.lit("src is no vertex").alias("rule"), F.col("eid").alias("id"))
    out = out.union(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.lit("dst is no vertex"), "eid"))
    out = out.union(vertices.filter("id is null").select(F.lit("vertex id is null"), "id"))
    out = out.union(vertices.groupBy("id").count().filter("count > 1").select(F.lit("vertex id repeats"), "id"))
    return out.union(edges.groupBy("eid").count().filter("count > 1").select(F.lit("edge id repeats"), "eid"))
