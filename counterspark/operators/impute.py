"""Null policies for the target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate(series: DataFrame) -> DataFrame:
    """Linear by row position in date order; the ends take their nearest value."""
    w = Window.partitionBy("series_id").orderBy("ds")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    at = F.when(F.col("y").isNotNull(), F.col("_p"))
    df = series.withColumn("_p", pos)
    df = (
        df.withColumn("_y0", F.last("y", True).over(back)).withColumn("_p0", F.last(at, True).over(back))
        .withColumn("_y1", F.first("y", True).over(ahead)).withColumn("_p1", F.first(at, True).over(ahead))
    )
    between = F.expr("_y0 + (_y1 - _y0) * (_p - _p0) / nullif(_p1 - _p0, 0)")
    return df.withColumn("y", F.coalesce("y", between, "_y0", "_y1")).drop("_p", "_y0", "_p0", "_y1", "_p1")


def apply_missing(series: DataFrame, policy: str) -> DataFrame:
    """``series`` under the policy 'error', 'drop' or 'interpolate'."""
    if policy == "drop":
        return series.na.drop(subset=["y"])
    if policy == "interpolate":
        return interpolate(series)
    if policy != "error":
        raise ValueError(f"missing_data must be 'error', 'drop' or 'interpolate', got {policy!r}.")
    n = series.where("y is null").count()
    if n:
        raise ValueError(f"{n} missing value(s) in the target; set missing_data to 'drop' or 'interpolate', or fill them.")
    return series
