"""Vertex programs: gather along edges, combine, apply, activate, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.kernels import reducer


@dataclass
class VertexProgram:
    """What each round does; all expressions are over named columns.

    init: state columns over the vertex table. message: over ``from_<state>`` of the sender and the
    edge's columns. combine: sum, mean, min, max, mul, or a function from the message to an aggregate.
    apply: new state over the old state and ``msg``, which is null where nothing arrived. changed: over
    the new state and ``old_<state>``; by default any difference. direction: out sends along edges, in
    against them, both either way.

    active: "changed": who changed sends, all receive; "all": everybody sends in every round;
    "gather": active vertices recompute from all their neighbours, and who changed activates the
    vertices at the other end of its edges. activate: over the new state, ``old_<state>`` and ``_changed``;
    who is true is active in the next round too. hold: given the number of the round that ends, whether
    the active vertices stay the same in the next one. frontier: over the state; only senders for which it holds send.

    ``edge_update`` sets edge attributes at the end of each round, over ``src_<state>``, ``dst_<state>`` and
    the edge's columns; the next round's messages read them. scatter: out, in or both: the edges at which
    vertices that took part in a round update edges and, with "gather", activate others; by default
    edges are updated at both ends, and the receivers of a vertex's messages are activated.

    prepare: from the graph to its vertices with further columns, which ``init`` may use.
    max_iter: rounds at most, None: until nothing changes. fixed: exactly max_iter rounds.
    """

    init: dict[str, Column]
    message: Column
    combine: str | Callable[[Column], Column]
    apply: dict[str, Column]
    changed: Column | None = None
    direction: str = "out"
    active: str = "changed"
    start: Column | None = None
    max_iter: int | None = None
    fixed: bool = False
    push_pull: bool = True
    push_ratio: float = 1 / 15
    edge_update: dict[str, Column] = field(default_factory=dict)
    scatter: str | None = None
    activate: Column | None = None
    hold: Callable[[int], bool] | None = None
    frontier: Column | None = None
    prepare: Callable[..., DataFrame] | None = None

    def __post_init__(self):
        if self.direction not in ("out", "in", "both"):
            raise ValueError(f"unknown direction {self.direction!r}")
        if self.scatter not in (None, "out", "in", "both"):
            raise ValueError(f"unknown direction {self.scatter!r}")
        if self.active not in ("changed", "all", "gather"):
            raise ValueError(f"unknown activation {self.active!r}")
        if self.fixed and self.max_iter is None:
            raise ValueError("a fixed number of rounds needs max_iter")

    def aggregate(self) -> Column:
        return (self.combine(F.col("_message")) if callable(self.combine) else reducer(self.combine, F.col("_message"))).alias("msg")

    def run(self, graph) -> Result:
        from vertexloom.plans.engine import run

        return run(self, graph)


@dataclass
class Result:
    """The final state, and how the run went."""

    vertices: DataFrame
    edges: DataFrame
    iterations: int
    converged: bool
    push_count: int = 0
    pull_count: int = 0
    seconds: float = 0.0

    def summary(self) -> DataFrame:
        row = (self.iterations, self.converged, self.push_count, self.pull_count, self.seconds / max(1, self.iterations))
        return self.vertices.sparkSession.createDataFrame([row], "iterations int, converged boolean, push_count int, pull_count int, seconds_per_round double")
