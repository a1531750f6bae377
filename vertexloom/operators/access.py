"""Access to graphs: degrees, neighbours, incident edges, subgraphs, attributes."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import kernels
from vertexloom.operators import etl

if TYPE_CHECKING:
    from vertexloom.model import Graph


def degree(graph: Graph, mode: str = "out") -> DataFrame:
    """(id, deg) of all vertices, 0 for those without edges. ``mode``: out, in or all."""
    if mode == "all":
        ends = _ends(graph, "all").select("id")
    else:
        ends = graph.edges.select(F.col({"out": "src", "in": "dst"}[mode]).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("deg"))
    return graph.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def degree_histogram(graph: Graph, mode: str = "out") -> DataFrame:
    return degree(graph, mode).groupBy("deg").agg(F.count("*").alias("n"))


def _ends(graph: Graph, mode: str) -> DataFrame:
    """(id, nbr, eid, dir): each edge seen from its ends. For undirected graphs, which hold both
    directions, all is the same as out."""
    out = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "eid", F.lit("out").alias("dir"))
    into = graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "eid", F.lit("in").alias("dir"))
    if mode == "all":
        return out.unionByName(into) if graph.directed else out
    return {"out": out, "in": into}[mode]


def check_ids(graph: Graph, ids: DataFrame) -> None:
    """Raise ValueError if some id is no vertex."""
    bad = ids.select("id").join(graph.vertices.select("id"), "id", "left_anti").take(5)
    if bad:
        raise ValueError(f"no vertices: {[r['id'] for r in bad]}")


def neighbors(graph: Graph, ids: DataFrame | None = None, mode: str = "out", form: str = "long", strict: bool = False) -> DataFrame:
    """The neighbours of ``ids`` (all vertices without it). An id asked for twice is answered twice.

    ``form``: long: (id, nbr, eid, dir), a row each; array: (id, nbrs, eids), in the order of neighbour
    and edge, empty for vertices without; padded: (id, nbrs, eids, mask), arrays of the largest
    degree, filled with -1.
    """
    if strict and ids is not None:
        check_ids(graph, ids)
    ends = _ends(graph, mode)
    rows = ends if ids is None else ids.select("id").join(ends, "id")
    if form == "long":
        return rows
    asked = graph.vertices.select("id") if ids is None else ids.select("id").join(graph.vertices.select("id"), "id", "left_semi")
    cells = F.array_sort(F.collect_list(F.struct("dir", "nbr", "eid")))
    lists = ends.join(asked.distinct(), "id", "left_semi").groupBy("id").agg(cells.alias("cells"))
    none = F.array().cast("array<bigint>")
    lists = asked.join(lists, "id", "left").select("id", F.coalesce("cells.nbr", none).alias("nbrs"), F.coalesce("cells.eid", none).alias("eids"))
    if form == "array":
        return lists
    width = lists.agg(F.max(F.size("nbrs"))).first()[0] or 0
    return lists.select("id", kernels.pad(F.col("nbrs"), width).alias("nbrs"), kernels.pad(F.col("eids"), width).alias("eids"), kernels.mask(F.col("nbrs"), width).alias("mask"))


def induced(graph: Graph, ids: DataFrame, renumber: bool = False) -> Graph:
    ids = ids.select("id").distinct()
    v = graph.vertices.join(ids, "id", "left_semi")
    e = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.select(*graph.edges.columns)
    if renumber:
        v, e = etl.renumber(v, e)
    return replace(graph, vertices=v, edges=e)


def row_slice(graph: Graph, ids: DataFrame) -> Graph:
    ids = ids.select("id").distinct()
    e = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*graph.edges.columns)
    return replace(graph, vertices=graph.vertices.join(ids, "id", "left_semi"), edges=e)


def lookup(table: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) for each id asked for; null where the attribute is missing."""
    return ids.select(key).join(table.select(key, name), key)


def update(table: DataFrame, updates: DataFrame, key: str, name: str) -> DataFrame:
    """Set ``name`` for the rows in ``updates`` (key, name[, mask]); others keep theirs."""
    value = F.when(F.col("mask"), F.col(name)) if "mask" in updates.columns else F.col(name)
    new = updates.select(key, value.alias("_new"), F.lit(True).alias("_hit"))
    old = F.col(name) if name in table.columns else F.lit(None)
    columns = [c for c in table.columns if c != name]
    return table.join(new, key, "left").select(*columns, F.when(F.col("_hit"), F.col("_new")).otherwise(old).alias(name))
