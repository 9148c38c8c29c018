"""Passage counts over a stream of visits. An addition to the engine, not a part of what it re-expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_passage(visits: DataFrame, ts: str = "ts", edge: str = "edge_id", length: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, edge, n) per window; windows close once the watermark has passed them."""
    counts = visits.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), F.col(edge)).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), edge, "n")
