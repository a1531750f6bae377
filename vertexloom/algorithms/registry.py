"""Programs by name."""

from __future__ import annotations

from collections.abc import Callable

from vertexloom.algorithms.bfs import bfs
from vertexloom.algorithms.hits import hits
from vertexloom.algorithms.pagerank import pagerank
from vertexloom.algorithms.sssp import sssp
from vertexloom.algorithms.wcc import wcc

#: What runs a named algorithm over a graph: (graph, **parameters) -> vertices.
NAMES: dict[str, Callable] = {
    "BFS": bfs,
    "PageRank": lambda graph, **p: pagerank(graph, **({"teleport": "1/n"} | p)),
    "SSSP": sssp,
    "ConnectedComponents": wcc,
    "HITS": hits,
}


def get_program(name: str, **parameters) -> Callable:
    """A function from a graph to the result; an unknown name raises ValueError."""
    if name not in NAMES:
        raise ValueError(f"unknown program {name!r}; known: {', '.join(NAMES)}")
    return lambda graph: NAMES[name](graph, **parameters)
