"""Residual diagnostics: moments, autocorrelation, Ljung-Box, Shapiro-Wilk, plot data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import acf, chi2_sf, normal_quantiles, order_statistic_medians, pacf_yule_walker, shapiro_wilk

MIN_ACF_PAIRS = 30
NON_SEASONAL_DEPTH = 10
MAX_SHAPIRO = 5000


def clean_residuals(fits: DataFrame) -> DataFrame:
    """(series_id, pos, e) of the non-null residuals, numbered anew, with n and the mean."""
    w = Window.partitionBy("series_id")
    kept = fits.where(F.col("residual").isNotNull() & ~F.isnan("residual"))
    return kept.select("series_id", (F.row_number().over(w.orderBy("pos")) - 1).alias("pos"), F.col("residual").alias("e"), F.count("*").over(w).alias("n"), F.avg("residual").over(w).alias("mean"))


def max_lag(n):
    return F.greatest(F.lit(0), F.least(F.floor(n / 2).cast("int"), (n - MIN_ACF_PAIRS).cast("int")))


def residual_acf(fits: DataFrame, extra_lags: list[int] | None = None) -> DataFrame:
    """(series_id, lag, n, max_lag, acf): biased autocorrelations of every lag up to max_lag.

    Residuals of a series become one array (a bounded series); each lag is a dot
    product of two slices, in the JVM.  ``extra_lags`` past max_lag have null acf.
    """
    r = clean_residuals(fits)
    one = r.groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", (F.col("e") - F.col("mean")).alias("d")))), lambda x: x["d"]).alias("d"), F.first("n").alias("n"))
    one = one.withColumn("max_lag", max_lag(F.col("n"))).withColumn("c0", F.aggregate("d", F.lit(0.0), lambda a, x: a + x * x))
    wanted = F.when(F.col("max_lag") > 0, F.sequence(F.lit(1), F.col("max_lag"))).otherwise(F.array().cast("array<int>"))
    if extra_lags:
        wanted = F.array_union(wanted, F.array(*[F.lit(int(x)) for x in extra_lags]))
    lags = one.select("*", F.explode(wanted).alias("lag"))
    dot = F.aggregate(
        F.zip_with(F.slice("d", F.lit(1), F.col("n").cast("int") - F.col("lag")), F.slice("d", F.col("lag") + 1, F.col("n").cast("int") - F.col("lag")), lambda a, b: a * b),
        F.lit(0.0), lambda a, x: a + x,
    )
    value = F.when(F.col("lag") > F.col("max_lag"), None).when(F.col("c0") == 0, 0.0).otherwise(dot / F.col("c0"))
    return lags.select("series_id", "lag", "n", "max_lag", value.alias("acf"))


def ljung_box_depth(n, m: int | None):
    target = NON_SEASONAL_DEPTH if m is None else 2 * m
    return F.greatest(F.lit(1), F.least(F.lit(target), F.floor(n / 5).cast("int")))


def _depth_acf(fits: DataFrame, m: int | None) -> DataFrame:
    """Autocorrelations up to the Ljung-Box depth, which may pass max_lag."""
    r = clean_residuals(fits).where("n > 15")
    pairs = r.withColumn("depth", ljung_box_depth(F.col("n"), m)).withColumn("lag", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    other = r.select("series_id", F.col("pos").alias("p2"), (F.col("e") - F.col("mean")).alias("d2"))
    prod = pairs.join(other, (pairs.series_id == other.series_id) & (pairs.pos + pairs.lag == other.p2)).select(pairs.series_id, "lag", "n", "depth", ((F.col("e") - F.col("mean")) * F.col("d2")).alias("x"))
    c0 = r.groupBy("series_id").agg(F.sum((F.col("e") - F.col("mean")) * (F.col("e") - F.col("mean"))).alias("c0"))
    return prod.groupBy("series_id", "lag", "n", "depth").agg(F.sum("x").alias("c")).join(c0, "series_id").withColumn("acf", F.coalesce(F.try_divide("c", "c0"), F.lit(0.0)))


def ljung_box(fits: DataFrame, m: int | None) -> DataFrame:
    """(series_id, n, ljung_box_lags, ljung_box_stat) for series with more than 15 residuals."""
    rho = _depth_acf(fits, m)
    return rho.groupBy("series_id", "n", "depth").agg((F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("s")).select(
        "series_id", "n", F.col("depth").alias("ljung_box_lags"), (F.col("s") * F.col("n") * (F.col("n") + 2)).alias("ljung_box_stat")
    )


@F.pandas_udf(T.DoubleType())
def ljung_box_pvalue(stat: pd.Series, lags: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(s, k) for s, k in zip(stat, lags)])


@F.pandas_udf(T.StructType([T.StructField("stat", T.DoubleType()), T.StructField("pvalue", T.DoubleType())]))
def _shapiro(values: pd.Series) -> pd.DataFrame:
    out = []
    for v in values:
        x = np.asarray(v, dtype=float)
        out.append(shapiro_wilk(x) if 3 <= len(x) <= MAX_SHAPIRO else (None, None))
    return pd.DataFrame(out, columns=["stat", "pvalue"], dtype=float)


def shapiro(fits: DataFrame) -> DataFrame:
    """(series_id, n, shapiro_stat, shapiro_pvalue); null outside 3 to 5000 residuals."""
    n = clean_residuals(fits)
    few = F.when(F.col("n") <= MAX_SHAPIRO, F.col("e"))  # longer series are not collected
    one = n.groupBy("series_id", "n").agg(F.collect_list(few).alias("v"))
    return one.withColumn("s", _shapiro("v")).select("series_id", "n", F.col("s.stat").alias("shapiro_stat"), F.col("s.pvalue").alias("shapiro_pvalue"))


def moments(fits: DataFrame) -> DataFrame:
    """(series_id, n, residual_mean, residual_std); the deviation of a single residual is 0."""
    kept = fits.where(F.col("residual").isNotNull() & ~F.isnan("residual"))
    return kept.groupBy("series_id").agg(F.count("*").alias("n"), F.avg("residual").alias("residual_mean"), F.coalesce(F.stddev_samp("residual"), F.lit(0.0)).alias("residual_std"))


def tidy(fits: DataFrame, model_name: str, m: int | None, alias: str | None) -> DataFrame:
    """All diagnostics in long form: section, statistic, lag, value, status and note."""
    key = [1] if m is None else sorted({1, m})
    mom = moments(fits)
    lags = residual_acf(fits, key)
    lb = ljung_box(fits, m).withColumn("p", ljung_box_pvalue("ljung_box_stat", F.col("ljung_box_lags").cast("double")))
    sw = shapiro(fits)
    text, none = (lambda s: F.lit(s).cast("string")), F.lit(None).cast("string")

    def row(section, statistic, value, lag=None, unit=None, computed=F.lit(True), note=none):
        fine = value.isNotNull() & ~F.isnan(value)
        status = F.when(~computed, "not_computed").when(fine, "ok").otherwise("nan")
        return F.struct(
            text(section).alias("section"), text(statistic).alias("statistic"), (lag if lag is not None else F.lit(None)).cast("int").alias("lag"),
            (text(unit) if unit else none).alias("lag_units"), F.when(status == "ok", value.cast("double")).alias("value"), status.alias("status"), F.when(status != "ok", note).alias("note"),
        )

    obs = "observations"
    head = mom.select("series_id", "n", F.explode(F.array(row("summary", "residual_mean", F.col("residual_mean")), row("summary", "residual_std", F.col("residual_std")))).alias("r"))
    late = F.concat(F.lit("key lag "), F.col("lag").cast("string"), F.lit(" exceeds max_lag="), F.col("max_lag").cast("string"), F.lit(" (n="), F.col("n").cast("string"), F.lit(" residuals)"))
    mid = lags.select("series_id", "n", row("acf", "acf", F.col("acf"), F.col("lag"), obs, F.col("lag") <= F.col("max_lag"), late).alias("r"))
    box = mom.select("series_id", "n").join(lb.drop("n"), "series_id", "left")
    done, skipped = F.col("ljung_box_lags").isNotNull(), F.when(F.col("n") <= 15, "n <= 15: Ljung-Box skipped").otherwise("Ljung-Box computation failed")
    box = box.select("series_id", "n", F.explode(F.array(
        row("ljung_box", "ljung_box_stat", F.col("ljung_box_stat"), computed=done, note=skipped), row("ljung_box", "ljung_box_pvalue", F.col("p"), computed=done, note=skipped),
        row("ljung_box", "ljung_box_lags", F.col("ljung_box_lags").cast("double"), unit=obs, computed=done, note=skipped))).alias("r"))
    why = F.when(F.col("n").between(3, MAX_SHAPIRO), "Shapiro-Wilk computation failed").otherwise(f"n outside 3..{MAX_SHAPIRO}")
    tail = sw.select("series_id", "n", F.explode(F.array(*[row("shapiro", s, F.col(s), computed=F.col(s).isNotNull(), note=why) for s in ("shapiro_stat", "shapiro_pvalue")])).alias("r"))
    par = mom.select("series_id", "n", F.explode(F.array(row("params", "max_lag", max_lag(F.col("n")).cast("double"), unit=obs), row("params", "min_acf_pairs", F.lit(float(MIN_ACF_PAIRS))))).alias("r"))
    out = head.union(mid).union(box).union(tail).union(par)
    return out.select("series_id", text(model_name).alias("model_name"), "r.section", "r.statistic", "r.lag", "r.lag_units", "r.value", "r.status", "r.note", text(alias).alias("freq_alias"), F.lit(m).cast("int").alias("m"), "n")


def residual_pacf(fits: DataFrame) -> DataFrame:
    """(series_id, lag, pacf) by Yule-Walker on the biased autocorrelations."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["residual"].dropna().to_numpy(dtype=float)
        n = len(x)
        k = min(max(0, min(n // 2, n - MIN_ACF_PAIRS)), n // 2 - 1)
        v = pacf_yule_walker(acf(x, k)) if k > 0 else np.empty(0)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "lag": np.arange(1, len(v) + 1, dtype=np.int32), "pacf": v})

    return fits.select("series_id", "pos", "residual").groupBy("series_id").applyInPandas(one, "series_id string, lag int, pacf double")


def residual_qq(fits: DataFrame) -> DataFrame:
    """(series_id, i, theoretical, ordered, slope, intercept) of a normal probability plot; none below 3 residuals."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf["residual"].dropna().to_numpy(dtype=float))
        if len(x) < 3:
            return pd.DataFrame({"series_id": [], "i": [], "theoretical": [], "ordered": [], "slope": [], "intercept": []})
        q = normal_quantiles(order_statistic_medians(len(x)))
        slope, intercept = np.polyfit(q, x, 1)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "i": np.arange(len(x), dtype=np.int32), "theoretical": q, "ordered": x, "slope": slope, "intercept": intercept})

    return fits.select("series_id", "residual").groupBy("series_id").applyInPandas(one, "series_id string, i int, theoretical double, ordered double, slope double, intercept double")


def acf_plot_data(fits: DataFrame, m: int | None) -> DataFrame:
    """Correlogram rows: lag, acf, the 1.96 / sqrt(n) band, and whether the lag is a key one."""
    key = [1] if m is None else sorted({1, m})
    return residual_acf(fits).select("series_id", "lag", "acf", (F.lit(1.96) / F.sqrt("n")).alias("band"), F.col("lag").isin(key).alias("is_key"))
