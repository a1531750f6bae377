"""PageRank, breadth-first search, shortest paths, components and HITS in all their variants."""

from vertexloom.algorithms.bfs import bfs
from vertexloom.algorithms.hits import hits
from vertexloom.algorithms.pagerank import pagerank
from vertexloom.algorithms.registry import get_program
from vertexloom.algorithms.sssp import sssp
from vertexloom.algorithms.wcc import wcc

__all__ = ["bfs", "get_program", "hits", "pagerank", "sssp", "wcc"]
