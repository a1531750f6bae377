"""Running sums and dense ranks over a whole table, without one task for all rows.

A window over an unpartitioned order would send every row to one task. Here the rows are range
partitioned and sorted, each partition is numbered or summed for itself, and the totals of earlier
partitions, one number each, are added. The ranged rows are written once, so that both passes see
the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexloom.plans.workspace import Workspace


def _ranged(df: DataFrame, order: list[str]) -> tuple[DataFrame, Column]:
    work = Workspace(df.sparkSession, "ranged")
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    return work.save(parts, "rows"), [F.col(c) for c in order]


def running(df: DataFrame, order: list[str], value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Add the sum of ``value`` over all rows before (or up to) each row in ``order``; ties are in the
    order of all further columns, so give a total order where it matters."""
    rows, keys = _ranged(df.withColumn("_value", value.cast("long")), order)
    totals = rows.groupBy("_part").agg(F.sum("_value").alias("_total"))
    # As many rows as partitions: a window over them all is small.
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    joined = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before.select("_part", "_before")), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_value", "_inside", "_before")


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add each row's place, from 0, in ``order``, which should be a total order."""
    return running(df, order, F.lit(1), name)


def following(df: DataFrame, order: list[str], column: str, name: str) -> DataFrame:
    """Add the value that ``column`` has in the next row in ``order``, a total order; null in the last row."""
    rows, keys = _ranged(df, order)
    # The first row of each partition follows the last one of the partition before: a row for each partition.
    firsts = rows.groupBy("_part").agg(F.min_by(column, F.struct(*keys)).alias("_first"))
    firsts = firsts.select("_part", F.lead("_first").over(Window.orderBy("_part")).alias("_first"))
    inside = F.lead(F.struct(column)).over(Window.partitionBy("_part").orderBy(*keys))
    joined = rows.withColumn("_next", inside).join(F.broadcast(firsts), "_part")
    return joined.withColumn(name, F.when(F.col("_next").isNotNull(), F.col(f"_next.{column}")).otherwise(F.col("_first"))).drop("_part", "_next", "_first")
