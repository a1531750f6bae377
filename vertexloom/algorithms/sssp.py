"""Single-source shortest paths by rounds of relaxation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from vertexloom.plans.program import Result, VertexProgram


def program(source: int, weight: str | None = None, zero=None, direction: str = "out", max_iter: int | None = None, push_pull: bool = True) -> VertexProgram:
    cost = F.col(weight) if weight else F.lit(1)
    zero = F.lit(0) if zero is None else zero
    return VertexProgram(
        init={"dist": F.when(F.col("id") == int(source), zero)}, message=F.col("from_dist") + cost, combine="min", apply={"dist": F.least("dist", "msg")},
        changed=(F.col("dist") < F.col("old_dist")) | (F.col("old_dist").isNull() & F.col("dist").isNotNull()),
        direction=direction, start=F.col("id") == int(source), max_iter=max_iter, push_pull=push_pull,
    )


def run(graph, source: int, weight: str | None = None, max_iter: int | None = None, **options) -> Result:
    """As ``sssp``, with the rounds. A path has fewer edges than there are vertices, so one round more
    that still improves a distance shows a negative cycle: ValueError."""
    kind = dict(graph.edges.dtypes)[weight] if weight else "bigint"
    zero = F.lit(0).cast("double" if kind in ("double", "float") else "bigint")
    p = program(source, weight, zero, max_iter=max_iter, **options)
    if max_iter is not None or not weight or not graph.edges.filter(F.col(weight) < 0).take(1):
        return p.run(graph)
    out = replace(p, max_iter=graph.num_vertices()).run(graph)
    if not out.converged:
        raise ValueError("a cycle of negative length can be reached from the source")
    return out


def sssp(graph, source: int, weight: str | None = None, max_iter: int | None = None, **options):
    """(id, dist): least sum of ``weight`` along edges from the source, 1 an edge without it; null if
    there is no way. Edges whose weight is null are no way."""
    return run(graph, source, weight, max_iter, **options).vertices
