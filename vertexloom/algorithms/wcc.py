"""Weakly connected components: the least vertex id of each component is its label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.program import Result, VertexProgram
from vertexloom.plans.workspace import Workspace


def program(max_iter: int | None = None, push_pull: bool = True) -> VertexProgram:
    """Labels travel along edges either way, a hop a round."""
    return VertexProgram(init={"label": F.col("id")}, message=F.col("from_label"), combine="min", apply={"label": F.least("label", "msg")}, direction="both", max_iter=max_iter, push_pull=push_pull)


def run(graph, max_iter: int | None = None, **options) -> Result:
    return program(max_iter, **options).run(graph)


def wcc(graph, max_iter: int | None = None, method: str = "stars"):
    """(id, label). ``method``: labels: rounds of label propagation, as many as the diameter, or
    max_iter; stars: alternating large and small stars, a logarithmic number of rounds."""
    if method == "labels" or max_iter is not None:
        return run(graph, max_iter).vertices
    if method != "stars":
        raise ValueError(f"unknown method {method!r}; known: labels, stars")
    low = stars(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.select("id").join(low, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def stars(links: DataFrame) -> DataFrame:
    """Links (a, b) -> (id, label) for every id of a link between different ids. Joins and aggregates
    only: the links of a hub are combined before they are shuffled."""
    work = Workspace(links.sparkSession, "stars")
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, step, before = work.save(pairs, "0"), 0, None
    while (mark := _mark(pairs)) != before and mark[0]:
        before, step = mark, step + 1
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        small = large.join(low.withColumnRenamed("v", "m"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = work.save(small.unionByName(low).distinct(), str(step))
        work.drop(str(step - 1))
    ends = pairs.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return ends.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
