"""Breadth-first search from one or several sources."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vertexloom.plans import engine
from vertexloom.plans.program import Result, VertexProgram
from vertexloom.plans.workspace import checkpointed, ship

#: Edges of a block, about, that a task holds as arrays.
BLOCK_EDGES = 2_000_000


def program(sources: list[int], direction: str = "out", max_iter: int | None = None, push_pull: bool = True, push_ratio: float = 1 / 15) -> VertexProgram:
    source = F.col("id").isin([int(s) for s in sources])
    return VertexProgram(
        init={"dist": F.when(source, F.lit(0))}, message=F.col("from_dist") + 1, combine="min", apply={"dist": F.least("dist", "msg")},
        changed=F.col("old_dist").isNull() & F.col("dist").isNotNull(), direction=direction, start=source, max_iter=max_iter, push_pull=push_pull, push_ratio=push_ratio,
    )


def run(graph, sources: list[int], **options) -> Result:
    return program(sources, **options).run(graph)


def bfs(graph, sources: list[int], **options):
    """(id, dist): hops from the nearest source along edges (``direction`` in: against them, both:
    either way); null if there is no way. Sources that are no vertices reach nothing."""
    return run(graph, sources, **options).vertices


def summary(levels):
    """(max_dist, reachable, unvisited) of a search or of shortest paths."""
    return levels.agg(F.max("dist").alias("max_dist"), F.count("dist").alias("reachable"), F.count_if(F.col("dist").isNull()).alias("unvisited"))


def _relaxed(edges: pa.Table, state: pa.Table) -> pa.Table:
    """Levels that a block's edges offer once its own vertices don't change any more."""
    ids = state["id"].to_numpy()
    order = np.argsort(ids)
    ids, dist = ids[order], state["dist"].to_numpy()[order].astype(np.int64)
    src, dst = edges["src"].to_numpy(), edges["dst"].to_numpy()
    if not len(ids) or not len(src):
        return pa.table({"id": pa.array([], pa.int64()), "offer": pa.array([], pa.int32())})
    at, to = np.searchsorted(ids, src), np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    inside = ids[to] == dst
    while True:
        before = dist.copy()
        np.minimum.at(dist, to[inside], dist[at[inside]] + 1)
        if (dist == before).all():
            break
    reached = dist[at] < engine.FAR
    seen, place = np.unique(dst[reached], return_inverse=True)
    best = np.full(len(seen), engine.FAR)
    np.minimum.at(best, place, dist[at[reached]] + 1)
    return pa.table({"id": seen, "offer": pa.array(best.astype(np.int32))})


def bfs_in_blocks(graph, sources: list[int], blocks: int | None = None):
    """As ``bfs``, with fewer rounds: vertices and the edges that leave them are dealt to blocks, and in a
    round each block searches on within itself as far as it gets before levels are exchanged."""
    spark = graph.vertices.sparkSession
    ship(spark)
    blocks = blocks or max(engine.partitions(spark), graph.num_edges() // BLOCK_EDGES + 1)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block")
    edges = checkpointed(graph.edges.select(block("src"), "src", "dst"))
    source = F.col("id").isin([int(s) for s in sources])
    state = checkpointed(graph.vertices.select("id", F.when(source, F.lit(0)).otherwise(F.lit(engine.FAR)).alias("dist"), source.alias("better")))
    while state.filter("better").take(1):
        offers = edges.groupBy("block").cogroup(state.select(block("id"), "id", "dist").groupBy("block")).applyInArrow(_relaxed, "id long, offer int")
        best = offers.groupBy("id").agg(F.min("offer").alias("offer"))
        new = F.least("dist", "offer")
        state = checkpointed(state.join(best, "id", "left").select("id", new.alias("dist"), (F.coalesce(F.col("offer"), F.lit(engine.FAR)) < F.col("dist")).alias("better")))
    return state.select("id", F.when(F.col("dist") < engine.FAR, F.col("dist")).alias("dist"))
