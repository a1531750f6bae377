"""PageRank: damped or not, teleport 1 or 1/n, all vertices each round or only active ones."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans import engine
from vertexloom.plans.program import Result, VertexProgram
from vertexloom.plans.workspace import Workspace

#: Rounds in one plan before the ranks are written.
ROUNDS_A_PLAN = 10


def _with_share(graph, direction: str):
    """The vertices with ``share``, 1 / the number of edges that they send along; null without any."""
    fan = graph.edges.groupBy(F.col("src" if direction == "in" else "dst").alias("id")).agg((1.0 / F.count("*")).alias("share"))
    return graph.vertices.select("id").join(fan, "id", "left")


def program(teleport: float, damping: float = 0.85, tol: float = 0.001, max_iter: int = 50, direction: str = "in", init: float = 1.0) -> VertexProgram:
    """Active vertices recompute; who moved by more than ``tol`` activates the receivers of its rank.
    The vertex table needs ``share``."""
    new = F.lit(teleport) + damping * F.coalesce("msg", F.lit(0.0))
    return VertexProgram(
        init={"rank": F.lit(float(init)), "delta": F.lit(0.0), "share": F.col("share")}, message=F.col("from_rank") * F.col("from_share"), combine="sum",
        apply={"rank": new, "delta": F.abs(new - F.col("rank"))}, changed=F.col("delta") > tol, direction="out" if direction == "in" else "in", active="gather", max_iter=max_iter,
    )


def pagerank(graph, max_iter: int = 50, damping: float = 0.85, teleport: str = "one", init: str = "one", tol: float | None = None, direction: str = "in") -> DataFrame:
    """(id, rank, delta) after ``max_iter`` rounds of rank = base + damping * sum(rank / out-degree) over
    in-neighbours (``direction`` "out": over out-neighbours and in-degrees). base is 1 - damping, or
    that over n with ``teleport`` "1/n"; ranks start at 1 or 1/n (``init``). Without damping (1.0) the
    base is 0. Vertices without out-edges keep their rank to themselves. With ``tol`` only active
    vertices recompute, and delta is that of a vertex's last recomputation."""
    for name, value in (("teleport", teleport), ("init", init)):
        if value not in ("one", "1/n"):
            raise ValueError(f"{name} is one or 1/n, not {value!r}")
    if direction not in ("in", "out"):
        raise ValueError(f"unknown direction {direction!r}")
    n = graph.num_vertices()
    base = (1 - damping) / (n if teleport == "1/n" and n else 1)
    first = 1.0 / n if init == "1/n" and n else 1.0
    if tol is not None:
        from dataclasses import replace

        shared = replace(graph, vertices=_with_share(graph, direction))
        return program(base, damping, tol, max_iter, direction, first).run(shared).vertices.select("id", "rank", "delta")
    return _rounds(graph, n, max_iter, damping, base, first, direction)


def _rounds(graph, n: int, rounds: int, damping: float, base: float, first: float, direction: str) -> DataFrame:
    """Many rounds as one plan. A round reads the ranks once: vertices joined to the sums of their
    edges, so the plan is a chain. Each rank is scaled once per vertex, before it goes along edges."""
    spark = graph.vertices.sparkSession
    work, parts = Workspace(spark, "pagerank"), engine.partitions(spark)
    small = engine.is_small(n, 2)
    edges = engine.Placed(engine.directed_edges(graph.edges.select("src", "dst"), "out" if direction == "in" else "in"), small)
    vertices = _with_share(graph, direction).repartition(parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
    state = vertices.withColumn("rank", F.lit(first))
    old = state
    for r in range(1, rounds + 1):
        if r == rounds or (r - 1) % ROUNDS_A_PLAN == 0 and r > 1:
            state = work.save(state, f"ranks{r}") if not small or r < rounds else state.persist(StorageLevel.MEMORY_AND_DISK)
        old = state
        sent = state.filter("share is not null").select(F.col("id").alias("frm"), (F.col("rank") * F.col("share")).alias("part"))
        got = edges.sent(sent, ["part"]).groupBy("to").agg(F.sum("part").alias("part"))
        state = vertices.join(F.broadcast(got) if small else got, vertices["id"] == got["to"], "left").select("id", "share", (F.lit(base) + damping * F.coalesce("part", F.lit(0.0))).alias("rank"))
    before = old.select(F.col("id").alias("_id"), F.col("rank").alias("_old"))
    out = state.join(before, F.col("id") == F.col("_id")).select("id", "rank", F.abs(F.col("rank") - F.col("_old")).alias("delta"))
    out = work.save(out, "result")
    edges.unpersist()
    vertices.unpersist()
    old.unpersist()
    return out


def run(graph, **options) -> Result:
    rounds = options.get("max_iter", 50)
    return Result(pagerank(graph, **options), graph.edges, rounds, False)
