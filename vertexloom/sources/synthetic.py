"""Generated graphs: a chain in both directions and random edges, without loops and duplicates."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vertexloom.model import Graph

#: Vertices and edges of the named sizes.
PRESETS = {"tiny": (20, 80), "small": (100, 500), "medium": (1000, 5000), "large": (10_000, 50_000)}


def chain_and_random(spark: SparkSession, n: int, m: int, seed: int = 42) -> Graph:
    """n vertices and m edges, or as many as the chain has if that is more, or as there can be."""
    chain = spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    chain = chain.union(chain.select("dst", "src"))
    missing = min(m, n * (n - 1)) - 2 * max(0, n - 1)
    edges = chain
    if missing > 0:
        # Pairs by number, from a hash of the seed; enough of them that the distinct ones suffice.
        tries = missing * 4 + 64 if m < n * (n - 1) // 4 else n * (n - 1) * 20
        number = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
        pairs = spark.range(tries).select(number(0).alias("src"), number(1).alias("dst")).filter("src <> dst").distinct()
        pairs = pairs.join(chain, ["src", "dst"], "left_anti")
        edges = chain.union(pairs.orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src", "dst").limit(missing))
    return Graph.from_edges(edges, spark.range(n))


def preset(spark: SparkSession, name: str, seed: int = 42) -> Graph:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return chain_and_random(spark, *PRESETS[name], seed)
