"""Edges as a stream: counts that a batch graph gives by ``degrees`` or ``type_counts``, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_counts(edges: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """start, end, type, edges: how many edges (src, dst, type, time) of each type each window got.

    Works on streams and on tables; rows later than ``late`` behind the newest are left out of a stream's windows.
    """
    seen = edges.withWatermark(time, late) if edges.isStreaming else edges
    over = F.window(time, window, slide) if slide else F.window(time, window)
    return seen.groupBy(over.alias("w"), "type").agg(F.count(F.lit(1)).alias("edges")).select("w.start", "w.end", "type", "edges")
