"""Degrees of a stream of edges, by windows of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(edges: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, id, deg): edges that leave each vertex in each window; later than ``late``: dropped.
    Works on streams and on tables alike."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width), F.col("src").alias("id")).agg(F.count("*").alias("deg"))
