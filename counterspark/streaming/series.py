"""A stream of events as the series that the batch plans read.

The analysis itself is a batch one; this only keeps its input current.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def streaming_totals(events: DataFrame, ts: str, value: Column, width: str = "1 day", late: str = "2 days", series: Column | None = None) -> DataFrame:
    """Closed windows of ``width`` with their sums, late events up to ``late`` included."""
    name = (series if series is not None else F.lit("all")).cast("string").alias("series_id")
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, width), name).agg(F.sum(value).cast("double").alias("y")).select(
        "series_id", F.col("window.start").cast("timestamp_ntz").alias("ds"), "y"
    )
