"""Observed minus expected: per observation, per period, and in total.

``preds``: series_id, ds, y, yhat, conf_lo, conf_hi and intervention_ts;
``sims``: series_id, ds, sim, yhat_sim (null where a simulation failed).
Failed simulations are left out of every interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bootstrap import limits
from .validate import period_family

FULL = "Full holdout"


def holdout(preds: DataFrame) -> DataFrame:
    """Holdout rows with their 0-based ``idx``."""
    w = Window.partitionBy("series_id").orderBy("ds")
    return preds.where(F.col("ds") >= F.col("intervention_ts")).withColumn("idx", F.row_number().over(w) - 1)


def excess_obs(preds: DataFrame, sims: DataFrame, level: float = 0.95) -> DataFrame:
    """Excess of each holdout row with percentile limits, absolute and in percent."""
    rows = preds.where(F.col("ds") >= F.col("intervention_ts"))
    joined = sims.join(rows.select("series_id", "ds", "y"), ["series_id", "ds"])
    ci = limits(joined, ["series_id", "ds"], F.col("y") - F.col("yhat_sim"), level, "excess_ci")
    pct = lambda c: F.when(F.col("yhat") != 0, F.try_divide(F.col(c), F.col("yhat")) * 100)
    out = rows.join(ci, ["series_id", "ds"], "left").withColumn("excess", F.col("y") - F.col("yhat"))
    # a negative expectation turns the percent limits round
    lo, hi = pct("excess_ci_lo"), pct("excess_ci_hi")
    return out.select(
        "series_id", F.col("ds").alias("date"), F.col("y").alias("observed"), F.col("yhat").alias("expected"),
        F.col("conf_lo").alias("expected_ci_lo"), F.col("conf_hi").alias("expected_ci_hi"), "excess", "excess_ci_lo", "excess_ci_hi",
        pct("excess").alias("excess_pct"), F.least(lo, hi).alias("excess_pct_ci_lo"), F.greatest(lo, hi).alias("excess_pct_ci_hi"),
    )


def periods_frame(spark: SparkSession, periods: list[dict] | None) -> DataFrame:
    """The configured periods after the full holdout, one row each."""
    rows = [(0, FULL, "obs", 0, None)]
    for i, p in enumerate(periods or [], 1):
        unit = period_family(p)
        rows.append((i, p["name"], unit, p.get(f"start_offset_{unit}") or 0, p.get(f"end_offset_{unit}")))
    return spark.createDataFrame(rows, "period_no int, period string, unit string, a int, b int")


def excess_period(preds: DataFrame, sims: DataFrame, periods: list[dict] | None = None, level: float = 0.95) -> DataFrame:
    """Totals of each period; limits are percentiles of per-simulation totals.  Periods without rows are left out."""
    spark = preds.sparkSession
    rows = holdout(preds)
    ends = rows.groupBy("series_id").agg(F.min("ds").alias("_h0"), F.max("ds").alias("_h1"))
    day = lambda c: F.col("_h0") + F.make_dt_interval(F.col(c))
    # a handful of periods: a bounded broadcast range join
    inside = F.when(F.col("unit") == "obs", (F.col("idx") >= F.col("a")) & (F.col("b").isNull() | (F.col("idx") <= F.col("b")))).otherwise(
        (F.col("ds") >= day("a")) & (F.col("b").isNull() | (F.col("ds") <= day("b")))
    )
    member = rows.join(ends, "series_id").join(F.broadcast(periods_frame(spark, periods)), inside)
    start = F.when(F.col("unit") == "days", day("a")).otherwise(F.col("ds"))
    stop = F.when(F.col("unit") == "days", F.coalesce(day("b"), F.col("_h1"))).otherwise(F.col("ds"))
    totals = member.groupBy("series_id", "period_no", "period").agg(
        F.min(start).alias("start_date"), F.max(stop).alias("end_date"), F.count("*").alias("n_obs"),
        F.coalesce(F.sum("y"), F.lit(0.0)).alias("total_observed"), F.coalesce(F.sum("yhat"), F.lit(0.0)).alias("total_expected"),
    )
    per_sim = (
        sims.join(member.select("series_id", "ds", "period_no"), ["series_id", "ds"])
        .groupBy("series_id", "period_no", "sim").agg(F.sum("yhat_sim").alias("s"))
    )
    with_total = per_sim.join(totals.select("series_id", "period_no", "total_observed"), ["series_id", "period_no"])
    ci = limits(with_total, ["series_id", "period_no"], F.col("total_observed") - F.col("s"), level, "excess_ci")
    total = F.col("total_observed") - F.col("total_expected")
    return totals.join(ci, ["series_id", "period_no"], "left").select(
        "series_id", "period_no", "period", "start_date", "end_date", "n_obs", "total_observed", "total_expected", total.alias("total_excess"),
        "excess_ci_lo", "excess_ci_hi", F.when(F.col("total_expected") != 0, F.try_divide(total, F.col("total_expected")) * 100).alias("excess_pct"),
    )


def ate_summary(period: DataFrame) -> DataFrame:
    """Total and mean effect with limits, from the full-holdout row of each series."""
    full = period.where(F.col("period") == FULL)
    row = lambda name, k: F.struct(
        F.lit(name).alias("metric"), (F.col("total_excess") / k).alias("estimate"), (F.col("excess_ci_lo") / k).alias("ci_lo"),
        (F.col("excess_ci_hi") / k).alias("ci_hi"), F.col("n_obs").alias("n_obs"),
    )
    both = F.array(row("Total ATE", F.lit(1.0)), row("Mean ATE per observation", F.col("n_obs").cast("double")))
    return full.select("series_id", F.explode(both).alias("r")).select("series_id", "r.*")
