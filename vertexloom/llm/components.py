"""Connected components of links: by joins over a table, and by union-find within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from vertexloom.algorithms.wcc import stars


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of long ids -> (id, component), for every id of a link between different ids;
    component: the least id that links reach. Nulls and repeated links are allowed; no links: no rows.
    Alternating large and small stars: a logarithmic number of rounds, each joins and aggregates, so
    that a hub's links are pre-aggregated or split as skewed join partitions."""
    return stars(links).withColumnRenamed("label", "component")


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.parts = n

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def union(self, i: int, j: int) -> bool:
        """Whether i and j were apart."""
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.parts -= 1
        return True

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[k] and b[k] for all k."""
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up
