"""The loop that runs vertex programs.

Edges are hashed by receiver once and kept, so that combining messages needs no shuffle in any round
while the senders' state can be broadcast, which the number of vertices decides. Larger states are
joined by shuffle: edges are then hashed by sender, and a round shuffles the state and the partly
combined messages, never the edges. Combined messages are no more than vertices, so where the state
can be broadcast they can be too. Each round ends in a checkpoint of the state in the shared folder,
so plans don't grow and a lost executor costs one round at most; the number of changed vertices
and of the edges that they would send along comes back.

The edges of hubs, vertices with more edges than a partition should have, would all be hashed to one
partition, and a cached relation is not split at run time. They are kept apart, spread by both ends:
their partly combined messages are shuffled, a row for each hub and partition, and where state is joined
by shuffle the state of the hubs, fewer than partitions, is broadcast to them.
"""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.plans.program import Result, VertexProgram
from vertexloom.plans.workspace import checkpointed

#: A state of at most so many bytes (rows times columns times 16) is broadcast.
BROADCAST_BYTES = 32 << 20
#: A level that no search reaches.
FAR = 1 << 30
#: A vertex with fewer edges is no hub, however few edges there are in all.
HUB_EDGES = 100_000
#: Partitions' shares of all edges that a hub has more than.
HUB_SHARE = 4.0


def directed_edges(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (frm, to, ...): who sends to whom."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("frm"), F.col("dst").alias("to"), *rest)
    into = edges.select(F.col("dst").alias("frm"), F.col("src").alias("to"), *rest)
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(rows: int, columns: int) -> bool:
    return rows * (columns + 1) * 16 <= BROADCAST_BYTES


class Placed:
    """Cached edges (frm, to, ...), hashed by receiver if senders can be broadcast, else by sender; those of hubs apart."""

    def __init__(self, edges: DataFrame, small: bool):
        self.small, n = small, partitions(edges.sparkSession)
        end = "to" if small else "frm"
        rows = edges.repartition(n, end).persist(StorageLevel.MEMORY_AND_DISK)
        self.count, self.parts, self.hubs = rows.count(), [rows], None
        least = max(HUB_EDGES, HUB_SHARE * self.count / n)
        if self.count <= least:
            return
        hubs = rows.groupBy(end).agg(F.count("*").alias("_n")).filter(F.col("_n") > least).select(end)
        if hubs.take(1):  # fewer than partitions
            self.hubs = checkpointed(hubs)
            few = F.broadcast(self.hubs)
            self.parts = [rows.join(few, end, "left_anti"), rows.join(few, end, "left_semi").repartition(n, "frm", "to")]
            self.parts = [p.persist(StorageLevel.MEMORY_AND_DISK) for p in self.parts]
            for p in self.parts:
                p.count()
            rows.unpersist()

    def sent(self, senders: DataFrame, message, receivers: DataFrame | None = None) -> DataFrame:
        """(to, message columns): the edges whose sender is in ``senders`` (frm, ...), whose receiver in ``receivers`` (to)."""
        out = None
        for i, part in enumerate(self.parts):
            if receivers is not None:
                part = part.join(F.broadcast(receivers) if self.small else receivers, "to", "left_semi")
            own = senders
            if i and not self.small:
                own = F.broadcast(senders.join(F.broadcast(self.hubs), "frm", "left_semi"))
            rows = part.join(F.broadcast(own) if self.small else own, "frm").select("to", *message)
            out = rows if out is None else out.unionByName(rows)
        return out

    def reached(self, senders: DataFrame) -> DataFrame:
        """(id): who is at the other end of an edge from ``senders`` (frm)."""
        return self.sent(senders, []).select(F.col("to").alias("id")).distinct()

    def fan(self) -> DataFrame:
        """(id, _fan): along how many edges each vertex sends."""
        each = [p.groupBy("frm").agg(F.count("*").alias("_fan")) for p in self.parts]
        out = each[0] if len(each) == 1 else each[0].unionByName(each[1]).groupBy("frm").agg(F.sum("_fan").alias("_fan"))
        return out.withColumnRenamed("frm", "id")

    def unpersist(self) -> None:
        for p in self.parts:
            p.unpersist()


def _differs(names: list[str]) -> Column:
    out = F.lit(False)
    for c in names:
        out = out | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return out


def _scattered(program: VertexProgram, edges: DataFrame, state: DataFrame, names: list[str]) -> DataFrame:
    """Edges after a round: those next to a vertex that took part, as ``scatter`` says, are updated."""
    s, d = (state.select(F.col("id").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in names], F.col("_may").alias(f"_{e}_may")) for e in ("src", "dst"))
    touched = {"out": F.col("_src_may"), "in": F.col("_dst_may"), "both": F.col("_src_may") | F.col("_dst_may")}[program.scatter or "both"]
    new = {n: F.when(touched, c).otherwise(F.col(n)) if n in edges.columns else F.when(touched, c) for n, c in program.edge_update.items()}
    both = edges.join(s, "src").join(d, "dst")
    return both.select(*[c for c in edges.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def run(program: VertexProgram, graph) -> Result:
    began, spark = time.time(), graph.vertices.sparkSession
    names = list(program.init)
    vertices = program.prepare(graph) if program.prepare else graph.vertices
    start = F.coalesce(program.start, F.lit(False)) if program.start is not None else F.lit(True)
    state = vertices.select("id", *[c.alias(n) for n, c in program.init.items()], start.alias("_active"))
    state = state.repartition(partitions(spark), "id").persist(StorageLevel.MEMORY_AND_DISK)
    small = is_small(state.count(), len(names))
    final_edges = graph.edges
    edges = Placed(directed_edges(final_edges, program.direction), small)
    wakes = edges if program.scatter in (None, program.direction) or program.active != "gather" else Placed(directed_edges(final_edges.select("src", "dst"), program.scatter), small)
    first, state = state, checkpointed(state.join(edges.fan(), "id", "left").select("id", *names, "_active", F.coalesce("_fan", F.lit(0)).alias("_fan")))
    first.unpersist()
    active, load = state.agg(F.count_if("_active"), F.sum(F.when(F.col("_active"), F.col("_fan")))).first()
    load, push, pull, rounds = load or 0, 0, 0, 0
    while (program.fixed or active) and (program.max_iter is None or rounds < program.max_iter):
        senders, receivers = state, None
        if program.active == "changed":
            # Pulling hears old messages again, which only a minimum or maximum bears.
            pushing = not program.push_pull or program.combine not in ("min", "max") or load < program.push_ratio * edges.count
            push, pull = push + pushing, pull + (not pushing)
            senders = state.filter("_active") if pushing else state
        if program.frontier is not None:
            senders = senders.filter(program.frontier)
        senders = senders.select(F.col("id").alias("frm"), *[F.col(c).alias(f"from_{c}") for c in names])
        if program.active == "gather":
            receivers = state.filter("_active").select(F.col("id").alias("to"))
        got = edges.sent(senders, [program.message.alias("_message")], receivers).groupBy("to").agg(program.aggregate())
        both = state.join(F.broadcast(got) if small else got, state["id"] == got["to"], "left").drop("to")
        may = F.col("_active") if program.active == "gather" else F.lit(True)
        new = both.select("id", "_fan", F.col("_active").alias("_was"), *[F.col(c).alias(f"old_{c}") for c in names], *[(F.when(may, program.apply[c]).otherwise(F.col(c)) if c in program.apply else F.col(c)).alias(c) for c in names], may.alias("_may"))
        differs = program.changed if program.changed is not None else _differs(names)
        new = new.withColumn("_changed", F.col("_may") & F.coalesce(differs, F.lit(False)))
        more = F.coalesce(program.activate, F.lit(False)) if program.activate is not None else F.lit(False)
        new = new.withColumn("_more", more)
        rounds += 1
        if program.hold is not None and program.hold(rounds):
            new = new.select("id", *names, F.col("_was").alias("_active"), "_fan", "_may")
        elif program.active == "gather":
            new = checkpointed(new.select("id", *names, "_fan", "_may", "_changed", "_more"))
            woken = wakes.reached(new.filter("_changed").select(F.col("id").alias("frm")))
            new = new.join(woken.withColumn("_active", F.lit(True)), "id", "left").select("id", *names, (F.coalesce("_active", F.lit(False)) | F.col("_more")).alias("_active"), "_fan", "_may")
        else:
            new = new.select("id", *names, (F.col("_changed") | F.col("_more")).alias("_active"), "_fan", "_may")
        state = checkpointed(new)
        if program.edge_update:
            final_edges = checkpointed(_scattered(program, final_edges, state, names))
            edges.unpersist()
            edges = Placed(directed_edges(final_edges, program.direction), small)
        active, load = state.agg(F.count_if("_active"), F.sum(F.when(F.col("_active"), F.col("_fan")))).first()
        load = load or 0
    edges.unpersist()
    wakes.unpersist()
    return Result(state.select("id", *names), final_edges, rounds, not active, push, pull, time.time() - began)
