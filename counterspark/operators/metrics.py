"""Error metrics as one aggregate per window."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def error_metrics(pairs: DataFrame, by: list[str], actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """RMSE, MAE and MAPE by ``by``; pairs with a null are skipped, one zero actual makes MAPE null."""
    e = F.col(actual) - F.col(predicted)
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    zero = F.count_if(both & (F.col(actual) == 0))
    return pairs.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.when(zero == 0, F.avg(F.abs(F.try_divide(e, F.col(actual)))) * 100).alias("mape"),
        zero.alias("n_zero"), F.count_if(both).alias("n_obs"),
    )


def seasonal_naive_mae(train: DataFrame, m: int | str, y: str = "y") -> DataFrame:
    """(series_id, mase_m, mase_denominator): mean of |y[t] - y[t-m]|; ``m`` is a number or a column's name.

    A self-join on position would shuffle twice; one window per lag sorts once.
    """
    w = Window.partitionBy("series_id").orderBy("ds")
    if isinstance(m, int):
        lagged = train.withColumn("_d", F.abs(F.col(y) - F.lag(y, m).over(w))).withColumn("_m", F.lit(m))
    else:
        rows = train.withColumn("_pos", F.row_number().over(w)).withColumn("_m", F.col(m))
        old = rows.select("series_id", (F.col("_pos") + F.col("_m")).alias("_pos"), F.col(y).alias("_old"))
        lagged = rows.join(old, ["series_id", "_pos"], "left").withColumn("_d", F.abs(F.col(y) - F.col("_old")))
    return lagged.groupBy("series_id").agg(F.first("_m").alias("mase_m"), F.avg("_d").alias("mase_denominator"))


def with_mase(metrics: DataFrame, scale: DataFrame) -> DataFrame:
    """``metrics`` with mase, null where the denominator is zero or missing."""
    return metrics.join(scale, "series_id", "left").withColumn("mase", F.try_divide("mae", "mase_denominator"))


def metrics_seasonality(seasonality, n_train: int, m: int | None) -> int:
    """The period for MASE: an explicit one must fit the training rows; 'auto' falls back to 1 with a warning."""
    if seasonality == "auto":
        if m is None:
            warnings.warn("No dominant seasonal period is mapped for this frequency; MASE uses m=1.", UserWarning, stacklevel=2)
            return 1
        if n_train < 2 * m:
            warnings.warn(f"{n_train} training rows are fewer than two cycles of m={m}; MASE uses m=1.", UserWarning, stacklevel=2)
            return 1
        return m
    if isinstance(seasonality, bool) or not isinstance(seasonality, int) or seasonality < 1:
        raise ValueError(f"metrics.seasonality must be 'auto' or an integer >= 1, got {seasonality!r}.")
    if n_train <= seasonality:
        raise ValueError(f"metrics.seasonality={seasonality} needs more than {seasonality} training rows, got {n_train}.")
    return seasonality
