"""A graph: a table of vertices (id, attributes) and one of edges (eid, src, dst, attributes)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.operators import access, etl


@dataclass(frozen=True)
class Graph:
    """Handle over two DataFrames. Undirected graphs hold both directions of each edge. Ids are any
    longs; a vertex without edges is a row of ``vertices``. Missing attributes are null."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, dedupe: bool = False, drop_loops: bool = False, renumber: bool = False) -> Graph:
        """From (src, dst, attributes); undirected graphs get reverse edges and are deduplicated, of
        repeated edges the least attributes stay. Without ``vertices``: the ends of edges."""
        if drop_loops:
            edges = etl.drop_self_loops(edges)
        if not directed:
            edges = etl.symmetrize(edges)
        if dedupe or not directed:
            edges = etl.dedupe(edges)
        if vertices is None:
            vertices = etl.endpoints(edges)
        if renumber:
            vertices, edges = etl.renumber(vertices, edges)
        if "eid" not in edges.columns:
            edges = etl.with_edge_ids(edges)
        return Graph(vertices, edges, directed)

    @staticmethod
    def read_csr(spark: SparkSession, path: str, long: bool | None = None, weighted: bool = False, directed: bool = False) -> Graph:
        """From CSR files; vertices are all numbers below their count, so also those without edges.
        ``long``: offsets are int64; without it the files tell."""
        from vertexloom.sources import csrbin

        return Graph(csrbin.read_vertices(spark, path, long), csrbin.read_edges(spark, path, long, weighted), directed)

    @staticmethod
    def read_csrc_text(spark: SparkSession, path: str) -> Graph:
        from vertexloom.sources import text

        return Graph(*text.read_csrc(spark, path), True)

    @staticmethod
    def read_edgelist(spark: SparkSession, path: str, sep: str | None = None, directed: bool = False, attrs: tuple[str, ...] = ()) -> Graph:
        from vertexloom.sources import text

        return Graph.from_edges(text.read_edgelist(spark, path, sep, attrs), directed=directed)

    def reverse(self) -> Graph:
        """The same vertices, every edge turned around, edge ids kept."""
        return replace(self, edges=etl.transpose(self.edges))

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def out_degree(self) -> DataFrame:
        return access.degree(self, "out")

    def in_degree(self) -> DataFrame:
        return access.degree(self, "in")

    def degree(self) -> DataFrame:
        """Out plus in for directed graphs; undirected ones hold both directions: out."""
        return access.degree(self, "all")

    def neighbors(self, ids: DataFrame | None = None, mode: str = "out", form: str = "long", strict: bool = False) -> DataFrame:
        return access.neighbors(self, ids, mode, form, strict)

    def subgraph(self, ids: DataFrame, renumber: bool = False) -> Graph:
        """The vertices ``ids`` and the edges with both ends among them."""
        return access.induced(self, ids, renumber)

    def slice(self, ids: DataFrame) -> Graph:
        """All edges that leave ``ids``; the vertices stay addressed by their own ids."""
        return access.row_slice(self, ids)

    def vertex_attr(self, ids: DataFrame, name: str) -> DataFrame:
        return access.lookup(self.vertices, ids, "id", name)

    def edge_attr(self, ids: DataFrame, name: str) -> DataFrame:
        return access.lookup(self.edges, ids, "eid", name)

    def filter_vertices(self, condition: Column | str) -> DataFrame:
        return self.vertices.filter(condition).select("id")

    def filter_edges(self, condition: Column | str) -> DataFrame:
        return self.edges.filter(condition).select("eid")

    def select_vertices(self, name: str, condition: Callable[[Column], Column]) -> DataFrame:
        return self.filter_vertices(condition(F.col(name)))

    def select_edges(self, name: str, condition: Callable[[Column], Column]) -> DataFrame:
        return self.filter_edges(condition(F.col(name)))

    def update_vertices(self, updates: DataFrame, name: str) -> Graph:
        """``updates``: (id, name[, mask]); rows whose mask is false become null."""
        return replace(self, vertices=access.update(self.vertices, updates, "id", name))

    def update_edges(self, updates: DataFrame, name: str) -> Graph:
        return replace(self, edges=access.update(self.edges, updates, "eid", name))

    def persist(self) -> Graph:
        return replace(self, vertices=self.vertices.persist(), edges=self.edges.persist())

    def unpersist(self) -> Graph:
        self.vertices.unpersist()
        self.edges.unpersist()
        return self
