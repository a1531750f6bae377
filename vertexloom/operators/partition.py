"""Partitioners: (id, part) for the vertices of a graph, and what a partition looks like."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import kernels
from vertexloom.operators import access, etl

if TYPE_CHECKING:
    from vertexloom.model import Graph


def assign_parts(graph: Graph, k: int, method: str = "range", alpha: int = 0) -> DataFrame:
    """``method``: range: equal numbers of vertices in the order of ids, the rest in the last part; ebp:
    ranges of ids with about equal numbers of edges; greedy: heaviest out-degree first to the
    lightest part; greedy_alpha: the same by out-degree + alpha."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    if method == "range":
        places = etl.numbering(graph.vertices)
        size = max(1, graph.num_vertices() // k)
        return places.select("id", F.least(F.lit(k - 1), F.floor(F.col("index") / size)).cast("int").alias("part"))
    if method == "ebp":
        begin = etl.offsets(graph.vertices, graph.edges)
        size = max(1, graph.num_edges() // k)
        return begin.select("id", F.least(F.lit(k - 1), F.floor(F.col("begin") / size)).cast("int").alias("part"))
    if method in ("greedy", "greedy_alpha"):
        weights = access.degree(graph, "out").select("id", (F.col("deg") + (alpha if method == "greedy_alpha" else 0)).alias("weight"))
        return kernels.balanced_split(weights, k)
    raise ValueError(f"unknown method {method!r}; known: range, ebp, greedy, greedy_alpha")


def part_sizes(graph: Graph, parts: DataFrame) -> DataFrame:
    """(part, n_vertices, n_edges): edges belong to the part of their source."""
    deg = access.degree(graph, "out").join(parts, "id")
    return deg.groupBy("part").agg(F.count("*").alias("n_vertices"), F.sum("deg").alias("n_edges"))


def cut_matrix(graph: Graph, parts: DataFrame) -> DataFrame:
    """(src_part, dst_part, n_edges)."""
    s, d = (parts.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part")) for c in ("src", "dst"))
    return graph.edges.join(s, "src").join(d, "dst").groupBy("src_part", "dst_part").agg(F.count("*").alias("n_edges"))


def exchange_plan(graph: Graph, parts: DataFrame) -> DataFrame:
    """What parts send each other when each boundary vertex is sent once: (src_part, dst_part,
    send_count, send_offset, recv_offset, recv_total)."""
    from pyspark.sql import Window

    s, d = (parts.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part")) for c in ("src", "dst"))
    sent = graph.edges.join(s, "src").join(d, "dst").filter("src_part <> dst_part").groupBy("src_part", "dst_part").agg(F.count_distinct("src").alias("send_count"))
    earlier = (Window.unboundedPreceding, -1)
    by_src = Window.partitionBy("src_part").orderBy("dst_part").rowsBetween(*earlier)
    by_dst = Window.partitionBy("dst_part").orderBy("src_part").rowsBetween(*earlier)
    return sent.select(
        "src_part", "dst_part", "send_count",
        F.coalesce(F.sum("send_count").over(by_src), F.lit(0)).alias("send_offset"),
        F.coalesce(F.sum("send_count").over(by_dst), F.lit(0)).alias("recv_offset"),
        F.sum("send_count").over(Window.partitionBy("dst_part")).alias("recv_total"),
    )


def part_edges(graph: Graph, parts: DataFrame) -> DataFrame:
    """(part, id, begin, eid, nbr): each part's edges, with the place where its vertex's begin in the part."""
    from pyspark.sql import Window

    deg = access.degree(graph, "out").join(parts, "id")
    begin = F.sum("deg").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    starts = deg.withColumn("begin", F.coalesce(begin, F.lit(0))).select("part", "id", "begin")
    edges = graph.edges.select(F.col("src").alias("id"), "eid", F.col("dst").alias("nbr"))
    return starts.join(edges, "id").select("part", "id", "begin", "eid", "nbr")
