"""Sources: anything Spark reads becomes one long relation of series.

Canonical columns: ``series_id`` STRING, ``ds`` TIMESTAMP_NTZ, ``y`` DOUBLE and
covariates DOUBLE.  NaN becomes NULL here, once, so every aggregate skips it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(col: Column) -> Column:
    """A double without NaN."""
    d = col.cast("double")
    return F.when(~F.isnan(d), d)


def ingest(df: DataFrame, date_col: str = "ds", target_col: str = "y", covariate_cols: Iterable[str] = (), series_col: str | None = None) -> DataFrame:
    """Canonical series of any frame; dates may be strings."""
    missing = [c for c in (date_col, target_col, *covariate_cols, *([series_col] if series_col else [])) if c not in df.columns]
    if missing:
        raise ValueError(f"Columns {missing} not found; available: {df.columns}.")
    series = F.col(series_col).cast("string") if series_col else F.lit("series")
    return df.select(
        series.alias("series_id"), F.col(date_col).cast("timestamp_ntz").alias("ds"), number(F.col(target_col)).alias("y"),
        *[number(F.col(c)).alias(c) for c in covariate_cols],
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def date_of_parts(year: str = "year", month: str = "month", day: str = "day") -> Column:
    return F.make_date(F.col(year), F.col(month), F.col(day))


def totals(df: DataFrame, ts: str, value: Column, unit: str, series: Column | None = None) -> DataFrame:
    """Series of sums by period: ``unit`` is hour, day, week (Monday), month or quarter."""
    return (
        df.groupBy((series if series is not None else F.lit("all")).cast("string").alias("series_id"), F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("ds"))
        .agg(F.sum(value).cast("double").alias("y"))
    )


def densify(series: DataFrame, step: str, fill: float | None = None) -> DataFrame:
    """The complete grid from each series' first to its last date, ``step`` apart ('1 day', '1 month' ...)."""
    ends = series.groupBy("series_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    grid = ends.select("series_id", F.explode(F.expr(f"sequence(a, b, interval {step})")).alias("ds"))
    out = grid.join(series, ["series_id", "ds"], "left")
    return out if fill is None else out.withColumn("y", F.coalesce("y", F.lit(float(fill))))


def specs(spark: SparkSession, rows: Iterable[tuple[str, str]]) -> DataFrame:
    """One row per series: its id and its event."""
    df = spark.createDataFrame(list(rows), "series_id string, event string")
    return df.select("series_id", F.col("event").cast("timestamp_ntz").alias("intervention_ts"))


def batch(series_list: list[dict], date_col: str = "ds", target_col: str = "y", covariate_cols: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(series, specs) of a list of dicts with ``series_id``, ``df`` and ``intervention_date``."""
    if not series_list:
        raise ValueError("series_list is empty.")
    out = None
    for i, item in enumerate(series_list):
        absent = {"series_id", "df", "intervention_date"} - set(item)
        if absent:
            raise ValueError(f"series_list[{i}] lacks {sorted(absent)}.")
        one = ingest(item["df"], date_col, target_col, covariate_cols).withColumn("series_id", F.lit(str(item["series_id"])))
        out = one if out is None else out.unionByName(one)
    return out, specs(out.sparkSession, [(str(x["series_id"]), str(x["intervention_date"])) for x in series_list])
