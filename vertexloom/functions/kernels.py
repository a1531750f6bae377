"""Segment and range functions: expansion of index ranges, reduction by index, padding, balanced split."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCERS = {"sum": F.sum, "add": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "mul": F.product, "product": F.product}
#: Slots that a split is sent for to the driver, at most; a number for each.
MAX_SPLIT = 20_000_000


def reducer(name: str, value: Column) -> Column:
    """The aggregate of that name; an unknown name raises ValueError."""
    if name not in REDUCERS:
        raise ValueError(f"unknown reduction {name!r}; known: {', '.join(sorted(REDUCERS))}")
    return REDUCERS[name](value)


def expand_ranges(ranges: DataFrame, start: str = "start", end: str = "end", value: str = "value") -> DataFrame:
    """One row for each number from start to end - 1, with all columns of its range, and its place
    ``pos`` in it. Empty, reversed and null ranges give none."""
    numbers = F.when(F.col(end) > F.col(start), F.sequence(F.col(start), F.col(end) - 1))
    return ranges.select("*", F.posexplode(numbers).alias("pos", value))


def range_offsets(ranges: DataFrame, order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Add ``ptr``, the place at which each range begins when all are laid out in ``order``."""
    from vertexloom.functions.prefix import running

    return running(ranges, order, F.greatest(F.col(end) - F.col(start), F.lit(0)), "ptr")


def padded_ranges(ranges: DataFrame, width: int, start: str = "start", end: str = "end", fill: int = -1) -> DataFrame:
    """Add ``values``, the range's numbers padded to ``width``, and ``mask``, which of them are real."""
    numbers = F.when(F.col(end) > F.col(start), F.sequence(F.col(start), F.col(end) - 1)).otherwise(F.array().cast("array<bigint>"))
    return ranges.withColumn("values", pad(numbers, width, fill)).withColumn("mask", mask(numbers, width))


def pad(values: Column, width: int | Column, fill: int = -1) -> Column:
    """The first ``width`` of an array, filled up to this length."""
    width = F.lit(width) if isinstance(width, int) else width
    values = values.cast("array<bigint>")
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(width - F.size(values), F.lit(0)))), F.lit(1), width)


def mask(values: Column, width: int | Column) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    real = F.least(F.size(values), width)
    return F.concat(F.array_repeat(F.lit(True), real), F.array_repeat(F.lit(False), width - real))


def scatter(rows: DataFrame, index: str, value: str, reduce: str = "sum", size: int | None = None, out: str = "value") -> DataFrame:
    """(index, out): the values of each index reduced by sum, mean, min, max or mul, for the indexes 0
    to size - 1, or to the largest one. Slots without a value are 0 for sum and mean, else null."""
    got = rows.groupBy(F.col(index).cast("long").alias("index")).agg(reducer(reduce, F.col(value)).alias(out))
    if size is None:
        size = (rows.agg(F.max(index)).first()[0] or -1) + 1 if rows.take(1) else 0
    slots = rows.sparkSession.range(size).withColumnRenamed("id", "index").join(got, "index", "left")
    return slots.withColumn(out, F.coalesce(out, F.lit(0))) if reduce in ("sum", "add", "mean", "avg") else slots


def segment_reduce(rows: DataFrame, keys: DataFrame, key: str, value: str, reduce: str = "sum", out: str = "value") -> DataFrame:
    """One row for each key of ``keys``: its values reduced. Keys without values are 0 for sum, null for
    min and max, which is what a minimum with an earlier value needs."""
    got = rows.groupBy(key).agg(reducer(reduce, F.col(value)).alias(out))
    joined = keys.select(key).join(got, key, "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0))) if reduce in ("sum", "add") else joined


def to_dense(rows: DataFrame, key: str, position: str, value: str, width: int, fill: int = -1) -> DataFrame:
    """One row for each key: its first ``width`` values by position, padded, and their mask."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).cast("long").alias("v"))))
    kept = rows.groupBy(key).agg(cells.alias("cells")).select(key, F.slice(F.col("cells.v"), 1, width).alias("kept"))
    return kept.select(key, pad(F.col("kept"), width, fill).alias("values"), mask(F.col("kept"), width).alias("mask"))


def balanced_split(weights: DataFrame, k: int, id: str = "id", weight: str = "weight") -> DataFrame:
    """(id, part): heaviest first, each to the part with the least weight so far; ties by id and part.

    The rule looks at one row after another, so ids and weights go to the driver: ``MAX_SPLIT`` of
    them at most. Beyond, ranges of equal weight (``edge_balanced``) split without the driver.
    """
    rows = weights.select(id, weight).limit(MAX_SPLIT + 1).toPandas()
    if len(rows) > MAX_SPLIT:
        raise ValueError(f"more than {MAX_SPLIT} rows; use the edge-balanced split")
    rows = rows.sort_values([weight, id], ascending=[False, True])
    loads = [(0, part) for part in range(min(k, max(len(rows), 1)))]
    parts = []
    for w in rows[weight].tolist():
        load, part = heapq.heappop(loads)
        parts.append(part)
        heapq.heappush(loads, (load + w, part))
    rows["part"] = parts
    return weights.sparkSession.createDataFrame(rows[[id, "part"]].rename(columns={id: "id"}), "id long, part int")


def count_distinct(rows: DataFrame, column: str, out: str = "n") -> DataFrame:
    return rows.agg(F.count_distinct(column).alias(out))
