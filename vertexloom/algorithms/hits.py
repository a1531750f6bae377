"""HITS: hub and authority values, updated together and normalised over all vertices."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.plans import engine
from vertexloom.plans.workspace import checkpointed


def hits(graph, max_iter: int = 50, tol: float | None = None) -> DataFrame:
    """(id, hub, authority, delta_hub, delta_authority) after exactly ``max_iter`` rounds.

    Values start at 1/n. In a round a hub is the sum of the old authorities behind its out-edges, an
    authority the sum of the old hubs behind its in-edges; both are divided by their Euclidean norm.
    With ``tol`` only active vertices are updated: at first all, then the neighbours, either way, of
    those that moved by more than ``tol``; the norm is still that over all vertices. A norm of 0, as
    without any edge, leaves zeros."""
    spark = graph.vertices.sparkSession
    parts = engine.partitions(spark)
    n = graph.num_vertices()
    small = engine.is_small(n, 5)
    one = graph.edges.select(F.col("dst").alias("frm"), F.col("src").alias("to"), F.lit(True).alias("for_hub"))
    two = graph.edges.select(F.col("src").alias("frm"), F.col("dst").alias("to"), F.lit(False).alias("for_hub"))
    edges = engine.Placed(one.unionByName(two), small)
    start = F.lit(1.0 / max(n, 1))
    zero = F.lit(0.0)
    state = graph.vertices.select("id", start.alias("hub"), start.alias("authority"), zero.alias("delta_hub"), zero.alias("delta_authority"), F.lit(True).alias("active"))
    state = checkpointed(state.repartition(parts, "id"))
    for r in range(1, max_iter + 1):
        senders = state.select(F.col("id").alias("frm"), "hub", "authority")
        receivers = state.filter("active").select(F.col("id").alias("to")) if tol is not None else None
        sums = edges.sent(senders, ["for_hub", "hub", "authority"], receivers).groupBy("to").agg(F.sum(F.when(F.col("for_hub"), F.col("authority"))).alias("h"), F.sum(F.when(~F.col("for_hub"), F.col("hub"))).alias("a"))
        raw = state.join(F.broadcast(sums) if small else sums, state["id"] == sums["to"], "left").select(
            "id", "active", F.col("hub").alias("old_hub"), F.col("authority").alias("old_authority"), "delta_hub", "delta_authority",
            F.when(F.col("active"), F.coalesce("h", zero)).otherwise(F.col("hub")).alias("hub"), F.when(F.col("active"), F.coalesce("a", zero)).otherwise(F.col("authority")).alias("authority"),
        ).persist(StorageLevel.MEMORY_AND_DISK)
        norms = raw.agg(F.sum(F.col("hub") * F.col("hub")), F.sum(F.col("authority") * F.col("authority"))).first()
        h, a = (math.sqrt(x) if x else 1.0 for x in norms)
        # Inactive vertices keep their value as it is; it took part in the norm.
        hub = F.when(F.col("active"), F.col("hub") / h).otherwise(F.col("hub"))
        authority = F.when(F.col("active"), F.col("authority") / a).otherwise(F.col("authority"))
        new = raw.select("id", hub.alias("hub"), authority.alias("authority"), F.when(F.col("active"), F.abs(hub - F.col("old_hub"))).otherwise(F.col("delta_hub")).alias("delta_hub"), F.when(F.col("active"), F.abs(authority - F.col("old_authority"))).otherwise(F.col("delta_authority")).alias("delta_authority"), "active")
        if tol is not None:
            moved = new.filter(F.col("active") & ((F.col("delta_hub") > tol) | (F.col("delta_authority") > tol))).select(F.col("id").alias("frm"))
            woken = edges.reached(moved).withColumn("_woken", F.lit(True))
            new = new.drop("active").join(woken, "id", "left").withColumn("active", F.coalesce("_woken", F.lit(False))).drop("_woken")
        state = checkpointed(new)
        raw.unpersist()
        if tol is not None and not state.filter("active").take(1):
            break
    edges.unpersist()
    return state.drop("active")
