"""Calendar features of a date column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_time_features(df: DataFrame, date_col: str = "ds") -> DataFrame:
    """Monday-based day of week, day of year, month and ISO week, all native."""
    return (
        df.withColumn("day_of_week", F.weekday(date_col))
        .withColumn("day_of_year", F.dayofyear(date_col))
        .withColumn("month", F.month(date_col))
        .withColumn("week_of_year", F.weekofyear(date_col))
    )
