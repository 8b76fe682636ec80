"""Queries of the analysis operators over the driver's tables, and their SQL.

The flagship slice is native from end to end: weekly quantities, grid proof, split at a
fixed event, closed-form baseline, residual blocks, refits of every simulation, limits
and excess.  Its SQL twin repeats the portable block starts.  The table is read once: what
follows the weekly totals reads them, persisted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.calendar import add_time_features
from .operators import bootstrap as bs
from .operators import diagnostics as dg
from .operators import excess as ex
from .operators import frequency as fq
from .operators import impute, metrics, validate
from .operators import splits as sp
from .sources.series import densify, specs, totals

EVENT = "2000-06-05"
N_SIM = 200
BLOCK = 14
M = 52
PERIODS_DAYS = [{"name": "First quarter", "start_offset_days": 0, "end_offset_days": 90}, {"name": "Later", "start_offset_days": 91}]
PERIODS_OBS = [{"name": "First 4", "start_offset_obs": 0, "end_offset_obs": 3}, {"name": "From 10", "start_offset_obs": 10}]


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return totals(_read(spark, d, "lineitem"), "l_shipdate", F.col("l_quantity"), "week")


def daily(spark: SparkSession, d: str) -> DataFrame:
    return totals(_read(spark, d, "lineitem"), "l_shipdate", F.col("l_quantity"), "day")


def event_specs(spark: SparkSession, series: str = "all") -> DataFrame:
    return specs(spark, [(series, EVENT)])


def weekly_splits(spark: SparkSession, d: str) -> DataFrame:
    return sp.assign_splits(weekly(spark, d).persist(StorageLevel.MEMORY_AND_DISK), event_specs(spark), "percent")


def baseline(splits: DataFrame, m: int = M) -> DataFrame:
    """Closed-form trend and season fitted on train rows: every row with ``base`` (and the fit's parts stay native)."""
    train = splits.where("split = 'train'")
    line = train.groupBy("series_id").agg(F.regr_slope("y", F.col("pos").cast("double")).alias("slope"), F.regr_intercept("y", F.col("pos").cast("double")).alias("icept"))
    with_line = splits.join(line, "series_id").withColumn("line", F.col("icept") + F.col("slope") * F.col("pos")).withColumn("phase", F.col("pos") % m)
    season = with_line.where("split = 'train'").groupBy("series_id", "phase").agg(F.avg(F.col("y") - F.col("line")).alias("season"))
    return with_line.join(season, ["series_id", "phase"], "left").withColumn("base", F.col("line") + F.coalesce("season", F.lit(0.0)))


def fits(spark: SparkSession, d: str) -> DataFrame:
    """Train rows with fitted values and residuals of the baseline."""
    b = baseline(weekly_splits(spark, d)).where("split = 'train'")
    return b.select("series_id", "pos", "ds", "y", F.col("base").alias("fitted"), (F.col("y") - F.col("base")).alias("residual"))


def sim_predictions(splits: DataFrame, n_sim: int = N_SIM, m: int = M, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(preds, sims): point predictions of test and holdout rows, and those of every refit."""
    spark = splits.sparkSession
    # a row per period and series: every branch below reads them, none goes back to the table
    b = baseline(splits, m).persist(StorageLevel.MEMORY_AND_DISK)
    train = b.where("split = 'train'").select("series_id", "pos", "base", (F.col("y") - F.col("base")).alias("residual"))
    sims = spark.range(n_sim).select(F.col("id").cast("int").alias("sim"))
    e = bs.resample_blocks_sql(train, sims, block)
    star = e.join(train.select("series_id", "pos", "base"), ["series_id", "pos"]).withColumn("ystar", F.col("base") + F.col("e"))
    pos = F.col("pos").cast("double")
    line = star.groupBy("series_id", "sim").agg(F.regr_slope("ystar", pos).alias("slope"), F.regr_intercept("ystar", pos).alias("icept"))
    season = (
        star.join(line, ["series_id", "sim"]).groupBy("series_id", "sim", (F.col("pos") % m).alias("phase"))
        .agg(F.avg(F.col("ystar") - F.col("icept") - F.col("slope") * F.col("pos")).alias("season"))
    )
    target = b.where("split in ('test', 'holdout')").select("series_id", "pos", "ds", "y", "split", "intervention_ts", "phase", F.col("base").alias("yhat"))
    ahead = target.select("series_id", "pos", "ds", "phase").join(line, "series_id").join(season, ["series_id", "sim", "phase"], "left")
    out = ahead.select("series_id", "sim", "pos", "ds", (F.col("icept") + F.col("slope") * F.col("pos") + F.coalesce("season", F.lit(0.0))).alias("yhat_sim"))
    return target.drop("phase"), out.persist(StorageLevel.MEMORY_AND_DISK)


def _preds_sims(spark: SparkSession, d: str, method: str = "quantile") -> tuple[DataFrame, DataFrame]:
    preds, sims = sim_predictions(weekly_splits(spark, d))
    return bs.confidence(preds, sims, ["series_id", "ds"], method), sims


def rounded(df: DataFrame, scale: int = 4) -> DataFrame:
    """Doubles rounded: engines add in different orders."""
    return df.select(*[F.round(c, scale).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- queries ---------------------------------------------------------------


def q_weekly_series(spark, d):
    return rounded(weekly(spark, d))


def q_grid_gaps(spark, d):
    orders = totals(_read(spark, d, "orders"), "o_orderdate", F.col("o_totalprice"), "day")
    g = fq.gaps(orders).where("gap_s is not null")
    return g.groupBy("gap_s").agg(F.count("*").alias("n")).select(F.col("gap_s").cast("bigint").alias("gap_s"), "n")


def q_first_departure(spark, d):
    orders = totals(_read(spark, d, "orders"), "o_orderdate", F.col("o_totalprice"), "day")
    return fq.first_departure(orders).select("series_id", F.col("modal_gap_s").cast("bigint").alias("modal_gap_s"), "prev", "ds", F.col("gap_s").cast("bigint").alias("gap_s"))


def q_grid_frequency(spark, d):
    li, o, e = _read(spark, d, "lineitem"), _read(spark, d, "orders"), _read(spark, d, "events")
    parts = [
        totals(li, "l_shipdate", F.col("l_quantity"), u, F.lit(f"lineitem_{u}")) for u in ("week", "month", "day")
    ] + [totals(o, "o_orderdate", F.col("o_totalprice"), u, F.lit(f"orders_{u}")) for u in ("month", "day")] + [totals(e, "ts", F.col("value"), "day", F.lit("events_day"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return fq.resolve_frequency(out).select("series_id", "n", "alias", "m", F.col("error").isNull().alias("regular"))


def q_densify(spark, d):
    orders = totals(_read(spark, d, "orders"), "o_orderdate", F.col("o_totalprice"), "day")
    return rounded(densify(orders, "1 day", 0.0), 2)


def q_validate_summary(spark, d):
    e = totals(_read(spark, d, "events"), "ts", F.col("value"), "day", F.col("event_type"))
    ids = e.select("series_id").distinct().withColumn("intervention_ts", F.lit("2024-01-21").cast("timestamp_ntz"))
    found = validate.findings(validate.summarise(e, ids))
    return rounded(found.select("series_id", "n_rows", "n_missing", "first_ds", "last_ds", "y_sd", "n_pre", F.size("warnings").alias("n_warnings"), F.col("error").isNull().alias("ok")))


def q_interpolate_linear(spark, d):
    w = Window.partitionBy("series_id").orderBy("ds")
    pos = F.row_number().over(w) - 1
    holes = weekly(spark, d).withColumn("p", pos).withColumn("y", F.when((F.col("p") % 7 < 5) & (F.col("p") > 3), F.col("y"))).drop("p")
    return rounded(impute.interpolate(holes))


def _split_query(method: str, **sizes):
    def query(spark, d):
        return rounded(sp.assign_splits(weekly(spark, d), event_specs(spark), method, **sizes).select("series_id", "ds", "y", "pos", "split"))

    return query


def q_calendar_features(spark, d):
    return add_time_features(daily(spark, d).select("ds"))


def _cv(spark, d):
    series = weekly(spark, d).where(F.col("ds") < F.lit(EVENT).cast("timestamp_ntz"))
    rows = series.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy("ds")) - 1)
    return rows, sp.fold_layout(spark, 10_000, 5, 20, 110, 5)


def q_cv_folds(spark, d):
    rows, folds = _cv(spark, d)
    return rounded(sp.fold_rows(rows, folds).select("fold", "part", "pos", "ds", "y"))


def q_cv_end_date(spark, d):
    return sp.cv_end_date(weekly(spark, d), event_specs(spark))


def q_cv_scores_baseline(spark, d):
    rows, folds = _cv(spark, d)
    f = sp.fold_rows(rows, folds)
    key = F.concat_ws("/", "series_id", F.col("fold").cast("string"))
    b = baseline(f.withColumn("series_id", key).withColumnRenamed("part", "split"))
    scores = metrics.error_metrics(b.where("split = 'test'"), ["fold"], "y", "base").select("fold", "rmse", "mae", "mape")
    return rounded(scores.agg(
        F.avg("rmse").alias("mean_rmse"), F.avg("mae").alias("mean_mae"), F.avg("mape").alias("mean_mape"),
        F.coalesce(F.stddev_samp("rmse"), F.lit(0.0)).alias("std_rmse"), F.coalesce(F.stddev_samp("mae"), F.lit(0.0)).alias("std_mae"), F.count("*").alias("n_folds"),
    ))


def q_seasonal_naive_mae(spark, d):
    return rounded(metrics.seasonal_naive_mae(weekly_splits(spark, d).where("split = 'train'"), M))


def q_error_metrics(spark, d):
    b = baseline(weekly_splits(spark, d)).where("split in ('train', 'test')")
    per = metrics.error_metrics(b.withColumnRenamed("split", "window"), ["series_id", "window"], "y", "base")
    return rounded(metrics.with_mase(per, metrics.seasonal_naive_mae(weekly_splits(spark, d).where("split = 'train'"), M)))


def q_mape_zero_guard(spark, d):
    e = _read(spark, d, "events").select(F.col("event_type").alias("series_id"), F.floor(F.col("value") / 40).cast("double").alias("y"), (F.col("value") / 40).alias("yhat"))
    return rounded(metrics.error_metrics(e, ["series_id"]))


def q_residual_acf(spark, d):
    return rounded(dg.residual_acf(fits(spark, d)), 6)


def q_key_lags(spark, d):
    key = sorted({1, M})
    return rounded(dg.residual_acf(fits(spark, d), key).where(F.col("lag").isin(key)).select("series_id", "lag", (F.col("lag") <= F.col("max_lag")).alias("computed"), "acf"), 6)


def q_ljung_box_stat(spark, d):
    return rounded(dg.ljung_box(fits(spark, d), M))


def q_residual_moments(spark, d):
    return rounded(dg.moments(fits(spark, d)), 6)


SHORT = (5, 13, 14, 15)


def q_block_resample(spark, d):
    """The residuals, and their first few as series no longer, or little longer, than a block."""
    r = fits(spark, d).select("series_id", "pos", "residual")
    for n in SHORT:
        r = r.union(fits(spark, d).where(F.col("pos") < n).select(F.lit(f"first{n}"), "pos", "residual"))
    sims = spark.range(50).select(F.col("id").cast("int").alias("sim"))
    return rounded(bs.resample_blocks_sql(r, sims, BLOCK))


def q_bootstrap_ci_quantile(spark, d):
    return rounded(_preds_sims(spark, d)[0].select("ds", "split", "y", "yhat", "conf_lo", "conf_hi"))


def q_bootstrap_ci_sd(spark, d):
    return rounded(_preds_sims(spark, d, "symmetric_sd")[0].select("ds", "split", "y", "yhat", "conf_lo", "conf_hi"))


def q_excess_obs(spark, d):
    return rounded(ex.excess_obs(*_preds_sims(spark, d)))


def q_excess_period_days(spark, d):
    return rounded(ex.excess_period(*_preds_sims(spark, d), PERIODS_DAYS))


def q_excess_period_obs(spark, d):
    return rounded(ex.excess_period(*_preds_sims(spark, d), PERIODS_OBS))


def q_ate_summary(spark, d):
    return rounded(ex.ate_summary(ex.excess_period(*_preds_sims(spark, d))))


def q_batch_ate(spark, d):
    """Three series in one plan; an irregular one is left to the errors."""
    s = totals(_read(spark, d, "lineitem"), "l_shipdate", F.col("l_quantity"), "week", F.col("l_returnflag")).persist(StorageLevel.MEMORY_AND_DISK)
    regular = fq.resolve_frequency(s).where("error is null").select("series_id")
    s = s.join(regular, "series_id")
    ids = specs(spark, [(x, EVENT) for x in "ANR"])
    preds, sims = sim_predictions(sp.assign_splits(s, ids), 100)
    preds = bs.confidence(preds, sims, ["series_id", "ds"])
    return rounded(ex.ate_summary(ex.excess_period(preds, sims)))


def q_diagnostics_tidy(spark, d):
    return rounded(dg.tidy(fits(spark, d), "baseline", M, "W-MON"), 6)


def q_diagnostics_rows(spark, d):
    """All of the diagnostics but those with a p-value and the Shapiro-Wilk test, which SQL lacks."""
    return q_diagnostics_tidy(spark, d).where("statistic not in ('ljung_box_pvalue', 'shapiro_stat', 'shapiro_pvalue')")


def q_residual_pacf(spark, d):
    return rounded(dg.residual_pacf(fits(spark, d)), 6)


def q_residual_qq(spark, d):
    return rounded(dg.residual_qq(fits(spark, d)), 6)


def _forecast(model: str):
    def query(spark, d):
        from .plans.batch import run_batch

        out = run_batch(weekly(spark, d), event_specs(spark), model)
        return out.preds.select("series_id", "ds", "split", "y", "yhat", "conf_lo", "conf_hi")

    return query


def q_tune_trials(spark, d):
    from .plans.tuning import tune_model

    r = tune_model(weekly(spark, d).select("ds", "y"), EVENT, "neuralprophet", split_method="percent")
    return spark.createDataFrame(r.trials)


def q_compare_models(spark, d):
    from .plans.tuning import compare_models

    r = compare_models(weekly(spark, d).select("ds", "y"), EVENT)
    return spark.createDataFrame(r.assign(error=r["error"].fillna("")))


def q_flagship(spark, d):
    """Weekly quantity's excess after the event, per observation."""
    return q_excess_obs(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "weekly_series": q_weekly_series, "grid_gaps": q_grid_gaps, "first_departure": q_first_departure, "grid_frequency": q_grid_frequency, "densify": q_densify,
    "validate_summary": q_validate_summary, "interpolate_linear": q_interpolate_linear,
    "split_percent": _split_query("percent"), "split_days": _split_query("days", test_days=200, holdout_days=250), "split_observations": _split_query("observations", test_obs=30, holdout_obs=40),
    "calendar_features": q_calendar_features, "cv_folds": q_cv_folds, "cv_end_date": q_cv_end_date, "cv_scores_baseline": q_cv_scores_baseline,
    "seasonal_naive_mae": q_seasonal_naive_mae, "error_metrics": q_error_metrics, "mape_zero_guard": q_mape_zero_guard,
    "residual_moments": q_residual_moments, "residual_acf": q_residual_acf, "key_lags": q_key_lags, "ljung_box_stat": q_ljung_box_stat, "block_resample": q_block_resample,
    "bootstrap_ci_quantile": q_bootstrap_ci_quantile, "bootstrap_ci_sd": q_bootstrap_ci_sd, "excess_obs": q_excess_obs,
    "excess_period_days": q_excess_period_days, "excess_period_obs": q_excess_period_obs, "ate_summary": q_ate_summary, "batch_ate": q_batch_ate,
    "diagnostics_tidy": q_diagnostics_tidy, "diagnostics_rows": q_diagnostics_rows, "residual_pacf": q_residual_pacf, "residual_qq": q_residual_qq,
    "arima_forecast": _forecast("arima"), "hybrid_forecast": _forecast("prophet_xgb"), "arnet_forecast": _forecast("neuralprophet"),
    "tune_trials": q_tune_trials, "compare_models": q_compare_models,
}

# ---- SQL -------------------------------------------------------------------

_WEEKLY = "weekly AS (SELECT 'all' AS series_id, date_trunc('week', l_shipdate)::TIMESTAMP AS ds, sum(l_quantity)::DOUBLE AS y FROM lineitem GROUP BY 2)"
_ORDERS = "series AS (SELECT 'all' AS series_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ds, sum(o_totalprice)::DOUBLE AS y FROM orders GROUP BY 2)"


def _splits_sql(source: str = "weekly", n_pre: str = "count(*) FILTER (ds < ev) OVER s", name: str = "splits") -> str:
    return f"""numbered AS (
  SELECT series_id, ds, y, ev, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS pos, {n_pre} AS n_pre, count(*) OVER s AS n_all
  FROM (SELECT *, TIMESTAMP '{EVENT}' AS ev FROM {source}) WINDOW s AS (PARTITION BY series_id)
), {name} AS (
  SELECT series_id, ds, y, ev, pos, CASE WHEN pos < n_pre - greatest(1, round_even(0.2 * n_pre, 0)) THEN 'train' WHEN pos < n_pre THEN 'test'
         WHEN pos < n_pre + greatest(1, round_even(1.0 * (n_all - n_pre), 0)) THEN 'holdout' ELSE 'unused' END AS split FROM numbered)"""


_BASE = f"""line AS (SELECT series_id, regr_slope(y, pos::DOUBLE) AS slope, regr_intercept(y, pos::DOUBLE) AS icept FROM splits WHERE split = 'train' GROUP BY 1),
lined AS (SELECT s.*, icept + slope * pos AS line, pos % {M} AS phase FROM splits s JOIN line USING (series_id)),
season AS (SELECT series_id, phase, avg(y - line) AS season FROM lined WHERE split = 'train' GROUP BY 1, 2),
based AS (SELECT l.*, line + coalesce(season, 0) AS base FROM lined l LEFT JOIN season USING (series_id, phase)),
fits AS (SELECT series_id, pos, ds, y, base AS fitted, y - base AS residual FROM based WHERE split = 'train')"""

_CLEAN = """clean AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS p, residual - avg(residual) OVER (PARTITION BY series_id) AS e,
  count(*) OVER (PARTITION BY series_id) AS n FROM fits),
c0 AS (SELECT series_id, sum(e * e) AS c0 FROM clean GROUP BY 1)"""


def _draw_sql(n_sim: int) -> str:
    return f"""len AS (SELECT series_id, n, CASE WHEN n <= {BLOCK} THEN 1 ELSE {BLOCK} END AS len FROM (SELECT series_id, count(*) AS n FROM train GROUP BY 1)),
draws AS (SELECT series_id, sim, b, n, len, ('0x' || substr(md5(sim || ':' || b || ':' || series_id), 1, 13))::BIGINT % (n - len + 1) AS start
  FROM len, range({n_sim}) AS r(sim), range(0, 4000) AS k(b) WHERE b * len < n),
e AS (SELECT d.series_id, sim, b * len + o AS pos, t.residual AS e FROM draws d, range({BLOCK}) AS q(o) JOIN train t ON t.series_id = d.series_id AND t.pos = d.start + o WHERE o < len AND b * len + o < n)"""


def _boot_sql(n_sim: int) -> str:
    return f"""train AS (SELECT series_id, pos, base, y - base AS residual FROM based WHERE split = 'train'),
{_draw_sql(n_sim)},
star AS (SELECT e.series_id, sim, pos, base + e AS ystar FROM e JOIN train USING (series_id, pos)),
sline AS (SELECT series_id, sim, regr_slope(ystar, pos::DOUBLE) AS slope, regr_intercept(ystar, pos::DOUBLE) AS icept FROM star GROUP BY 1, 2),
sseason AS (SELECT series_id, sim, pos % {M} AS phase, avg(ystar - icept - slope * pos) AS season FROM star JOIN sline USING (series_id, sim) GROUP BY 1, 2, 3),
target AS (SELECT series_id, pos, ds, y, split, ev, phase, base AS yhat FROM based WHERE split IN ('test', 'holdout')),
sims AS (SELECT t.series_id, l.sim, t.pos, t.ds, t.y, icept + slope * t.pos + coalesce(season, 0) AS yhat_sim FROM target t JOIN sline l USING (series_id)
  LEFT JOIN sseason s ON s.series_id = t.series_id AND s.sim = l.sim AND s.phase = t.phase)"""


_CI = """ci AS (SELECT series_id, ds, quantile_cont(yhat_sim, 0.025) AS conf_lo, quantile_cont(yhat_sim, 0.975) AS conf_hi, quantile_cont(y - yhat_sim, 0.025) AS e_lo,
  quantile_cont(y - yhat_sim, 0.975) AS e_hi, stddev_pop(yhat_sim) AS sd FROM sims GROUP BY 1, 2)"""

_SLICE = f"WITH {_WEEKLY}, {_splits_sql()}, {_BASE}"
_FULL = f"{_SLICE}, {_boot_sql(N_SIM)}, {_CI}"


def _periods_sql(periods: list[tuple[int, str, str, int, int | None]]) -> str:
    rows = ", ".join(f"({i}, '{n}', '{u}', {a}, {'NULL' if b is None else b})" for i, n, u, a, b in periods)
    return f"""periods AS (SELECT * FROM (VALUES (0, '{ex.FULL}', 'obs', 0, NULL::INT){', ' + rows if rows else ''}) AS v(period_no, period, unit, a, b)),
hold AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS idx, min(ds) OVER w AS h0, max(ds) OVER w AS h1 FROM target WHERE ds >= ev WINDOW w AS (PARTITION BY series_id)),
member AS (SELECT * FROM hold, periods WHERE CASE WHEN unit = 'obs' THEN idx >= a AND (b IS NULL OR idx <= b)
  ELSE ds >= h0 + a * INTERVAL 1 DAY AND (b IS NULL OR ds <= h0 + b * INTERVAL 1 DAY) END),
tot AS (SELECT series_id, period_no, period, min(CASE WHEN unit = 'days' THEN h0 + a * INTERVAL 1 DAY ELSE ds END) AS start_date,
  max(CASE WHEN unit = 'days' THEN coalesce(h0 + b * INTERVAL 1 DAY, h1) ELSE ds END) AS end_date, count(*) AS n_obs, coalesce(sum(y), 0) AS total_observed,
  coalesce(sum(yhat), 0) AS total_expected FROM member GROUP BY 1, 2, 3),
persim AS (SELECT m.series_id, period_no, sim, sum(yhat_sim) AS s FROM sims JOIN member m ON m.series_id = sims.series_id AND m.ds = sims.ds GROUP BY 1, 2, 3),
pci AS (SELECT p.series_id, p.period_no, quantile_cont(total_observed - s, 0.025) AS lo, quantile_cont(total_observed - s, 0.975) AS hi FROM persim p JOIN tot USING (series_id, period_no) GROUP BY 1, 2),
period AS (SELECT t.*, total_observed - total_expected AS total_excess, lo, hi FROM tot t LEFT JOIN pci USING (series_id, period_no))"""


_PERIOD_OUT = """SELECT series_id, period_no, period, start_date, end_date, n_obs, round(total_observed, 4) AS total_observed, round(total_expected, 4) AS total_expected,
  round(total_excess, 4) AS total_excess, round(lo, 4) AS excess_ci_lo, round(hi, 4) AS excess_ci_hi, round(CASE WHEN total_expected <> 0 THEN total_excess / total_expected * 100 END, 4) AS excess_pct FROM period"""

_ATE_OUT = """SELECT series_id, 'Total ATE' AS metric, round(total_excess, 4) AS estimate, round(lo, 4) AS ci_lo, round(hi, 4) AS ci_hi, n_obs FROM period WHERE period_no = 0
UNION ALL SELECT series_id, 'Mean ATE per observation', round(total_excess / n_obs, 4), round(lo / n_obs, 4), round(hi / n_obs, 4), n_obs FROM period WHERE period_no = 0"""

_METRIC = """round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(CASE WHEN count(*) FILTER (a = 0) = 0 THEN avg(abs(e / a)) * 100 END, 4) AS mape, count(*) FILTER (a = 0) AS n_zero, count(*) AS n_obs"""

_FOLDS = f"""cvrows AS (SELECT *, row_number() OVER (ORDER BY ds) - 1 AS pos FROM weekly WHERE ds < TIMESTAMP '{EVENT}'),
folds AS (SELECT i AS fold, 110 + i * 25 AS train_end, 130 + i * 25 AS test_end FROM range(5) AS r(i)),
foldrows AS (SELECT fold, CASE WHEN pos < train_end THEN 'train' ELSE 'test' END AS part, pos, ds, y FROM cvrows JOIN folds ON pos < test_end)"""

_ACF = """lags AS (SELECT series_id, n, greatest(0, least(n // 2, n - 30)) AS max_lag FROM (SELECT series_id, max(n) AS n FROM clean GROUP BY 1)),
acf AS (SELECT a.series_id, b.p - a.p AS lag, sum(a.e * b.e) AS c FROM clean a JOIN clean b ON a.series_id = b.series_id AND b.p > a.p GROUP BY 1, 2),
rho AS (SELECT series_id, lag, n, max_lag, CASE WHEN c0 = 0 THEN 0 ELSE c / c0 END AS acf FROM acf JOIN c0 USING (series_id) JOIN lags USING (series_id))"""

_PACF = """rr AS (SELECT series_id, max(n) AS n, list(acf ORDER BY lag) AS r FROM rho WHERE lag <= least(max_lag, n // 2 - 1) GROUP BY 1),
lev(series_id, r, k, phi, v, a) AS (
  SELECT series_id, r, 0::BIGINT, []::DOUBLE[], 1.0::DOUBLE, NULL::DOUBLE FROM rr
  UNION ALL
  SELECT series_id, r, k + 1, list_append([phi[i] - a1 * phi[k + 1 - i] FOR i IN range(1, k + 1)], a1), v * (1 - a1 * a1), a1
  FROM (SELECT *, CASE WHEN v > 0 THEN (r[k + 1] - coalesce(list_sum([phi[i] * r[k + 1 - i] FOR i IN range(1, k + 1)]), 0)) / v ELSE 0 END AS a1 FROM lev WHERE k < len(r)))"""

_SPLIT_OUT = "SELECT series_id, ds, round(y, 4) AS y, pos, split FROM splits"

SQL: dict[str, str] = {
    "weekly_series": f"WITH {_WEEKLY} SELECT series_id, ds, round(y, 4) AS y FROM weekly",
    "grid_gaps": f"WITH {_ORDERS}, g AS (SELECT epoch(ds - lag(ds) OVER (ORDER BY ds))::BIGINT AS gap_s FROM series) SELECT gap_s, count(*) AS n FROM g WHERE gap_s IS NOT NULL GROUP BY 1",
    "first_departure": f"""WITH {_ORDERS}, g AS (SELECT *, lag(ds) OVER (ORDER BY ds) AS prev FROM series), h AS (SELECT *, epoch(ds - prev)::BIGINT AS gap_s FROM g WHERE prev IS NOT NULL),
m AS (SELECT gap_s AS modal_gap_s FROM h GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT series_id, modal_gap_s, prev, ds, gap_s FROM h, m WHERE gap_s <> modal_gap_s ORDER BY ds LIMIT 1""",
    "grid_frequency": """WITH s AS (
SELECT 'lineitem_week' AS series_id, date_trunc('week', l_shipdate)::TIMESTAMP AS ds FROM lineitem UNION SELECT 'lineitem_month', date_trunc('month', l_shipdate)::TIMESTAMP FROM lineitem
UNION SELECT 'lineitem_day', date_trunc('day', l_shipdate)::TIMESTAMP FROM lineitem UNION SELECT 'orders_month', date_trunc('month', o_orderdate)::TIMESTAMP FROM orders
UNION SELECT 'orders_day', date_trunc('day', o_orderdate)::TIMESTAMP FROM orders UNION SELECT 'events_day', date_trunc('day', ts)::TIMESTAMP FROM events),
g AS (SELECT *, lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS prev FROM s),
h AS (SELECT *, epoch(ds - prev)::BIGINT AS gap, (year(ds) * 12 + month(ds)) - (year(prev) * 12 + month(prev)) AS mon FROM g),
a AS (SELECT series_id, count(*) AS n, min(gap) AS lo, max(gap) AS hi, min(mon) AS mlo, max(mon) AS mhi, bool_and(day(ds) = 1) AS firsts, min(ds) AS f FROM h GROUP BY 1),
r AS (SELECT series_id, n, CASE WHEN n < 3 THEN NULL WHEN mlo = mhi AND mlo = 1 AND firsts THEN 'MS' WHEN lo = hi AND lo = 86400 THEN 'D'
  WHEN lo = hi AND lo = 604800 THEN 'W-' || upper(left(dayname(f), 3)) END AS alias FROM a)
SELECT series_id, n, alias, CASE left(alias, 1) WHEN 'D' THEN 7 WHEN 'W' THEN 52 WHEN 'M' THEN 12 END AS m, alias IS NOT NULL AS regular FROM r""",
    "densify": f"WITH {_ORDERS}, ends AS (SELECT min(ds) AS a, max(ds) AS b FROM series) SELECT 'all' AS series_id, g.ds, round(coalesce(y, 0), 2) AS y FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ds FROM ends) g LEFT JOIN series USING (ds)",
    "validate_summary": """WITH s AS (SELECT event_type AS series_id, date_trunc('day', ts)::TIMESTAMP AS ds, sum(value)::DOUBLE AS y FROM events GROUP BY 1, 2),
a AS (SELECT series_id, count(*) AS n_rows, count(*) FILTER (y IS NULL) AS n_missing, min(ds) AS first_ds, max(ds) AS last_ds, stddev_samp(y) AS sd, count(*) FILTER (ds < TIMESTAMP '2024-01-21') AS n_pre FROM s GROUP BY 1)
SELECT series_id, n_rows, n_missing, first_ds, last_ds, round(sd, 4) AS y_sd, n_pre, (TIMESTAMP '2024-01-21' < first_ds OR TIMESTAMP '2024-01-21' > last_ds)::INT + (n_pre < 10)::INT + (n_missing / n_rows > 0.2)::INT AS n_warnings,
  NOT coalesce(sd = 0, false) AS ok FROM a""",
    "interpolate_linear": f"""WITH {_WEEKLY}, h AS (SELECT series_id, ds, p, CASE WHEN p % 7 < 5 AND p > 3 THEN y END AS y FROM (SELECT *, row_number() OVER (ORDER BY ds) - 1 AS p FROM weekly)),
f AS (SELECT *, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0, first_value(y IGNORE NULLS) OVER c AS y1,
  first_value(CASE WHEN y IS NOT NULL THEN p END IGNORE NULLS) OVER c AS p1 FROM h WINDOW b AS (ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, ds, round(coalesce(y, y0 + (y1 - y0) * (p - p0) / nullif(p1 - p0, 0), y0, y1), 4) AS y FROM f""",
    "split_percent": f"WITH {_WEEKLY}, {_splits_sql()} {_SPLIT_OUT}",
    "split_days": f"""WITH {_WEEKLY}, splits AS (SELECT series_id, ds, y, row_number() OVER (ORDER BY ds) - 1 AS pos, CASE WHEN ds < TIMESTAMP '{EVENT}' - INTERVAL 200 DAY THEN 'train' WHEN ds < TIMESTAMP '{EVENT}' THEN 'test'
  WHEN ds <= TIMESTAMP '{EVENT}' + INTERVAL 250 DAY THEN 'holdout' ELSE 'unused' END AS split FROM weekly) {_SPLIT_OUT}""",
    "split_observations": f"""WITH {_WEEKLY}, n AS (SELECT *, row_number() OVER (ORDER BY ds) - 1 AS pos, count(*) FILTER (ds < TIMESTAMP '{EVENT}') OVER () AS n_pre FROM weekly),
splits AS (SELECT series_id, ds, y, pos, CASE WHEN pos < n_pre - 30 THEN 'train' WHEN pos < n_pre THEN 'test' WHEN pos < n_pre + 40 THEN 'holdout' ELSE 'unused' END AS split FROM n) {_SPLIT_OUT}""",
    "calendar_features": "SELECT DISTINCT date_trunc('day', l_shipdate)::TIMESTAMP AS ds, isodow(l_shipdate)::INT - 1 AS day_of_week, dayofyear(l_shipdate)::INT AS day_of_year, month(l_shipdate)::INT AS month, weekofyear(l_shipdate)::INT AS week_of_year FROM lineitem",
    "cv_folds": f"WITH {_WEEKLY}, {_FOLDS} SELECT fold, part, pos, ds, round(y, 4) AS y FROM foldrows",
    "cv_end_date": f"WITH {_WEEKLY}, {_splits_sql()} SELECT series_id, coalesce(min(ds) FILTER (split = 'test'), TIMESTAMP '{EVENT}') AS cv_end_date FROM splits GROUP BY 1",
    "cv_scores_baseline": f"""WITH {_WEEKLY}, {_FOLDS}, fline AS (SELECT fold, regr_slope(y, pos::DOUBLE) AS slope, regr_intercept(y, pos::DOUBLE) AS icept FROM foldrows WHERE part = 'train' GROUP BY 1),
fseason AS (SELECT fold, pos % {M} AS phase, avg(y - icept - slope * pos) AS season FROM foldrows JOIN fline USING (fold) WHERE part = 'train' GROUP BY 1, 2),
t AS (SELECT r.fold, y AS a, y - (icept + slope * pos + coalesce(season, 0)) AS e FROM foldrows r JOIN fline USING (fold) LEFT JOIN fseason s ON s.fold = r.fold AND s.phase = r.pos % {M} WHERE part = 'test'),
sc AS (SELECT fold, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, CASE WHEN count(*) FILTER (a = 0) = 0 THEN avg(abs(e / a)) * 100 END AS mape FROM t GROUP BY 1)
SELECT round(avg(rmse), 4) AS mean_rmse, round(avg(mae), 4) AS mean_mae, round(avg(mape), 4) AS mean_mape, round(coalesce(stddev_samp(rmse), 0), 4) AS std_rmse, round(coalesce(stddev_samp(mae), 0), 4) AS std_mae, count(*) AS n_folds FROM sc""",
    "seasonal_naive_mae": f"WITH {_WEEKLY}, {_splits_sql()}, l AS (SELECT series_id, abs(y - lag(y, {M}) OVER (PARTITION BY series_id ORDER BY ds)) AS dd FROM splits WHERE split = 'train') SELECT series_id, {M} AS mase_m, round(avg(dd), 4) AS mase_denominator FROM l GROUP BY 1",
    "error_metrics": f"""{_SLICE}, t AS (SELECT series_id, split AS "window", y AS a, y - base AS e FROM based WHERE split IN ('train', 'test')), m AS (SELECT series_id, "window", {_METRIC}, avg(abs(e)) AS raw FROM t GROUP BY 1, 2),
l AS (SELECT series_id, abs(y - lag(y, {M}) OVER (PARTITION BY series_id ORDER BY ds)) AS dd FROM splits WHERE split = 'train'), d AS (SELECT series_id, avg(dd) AS den FROM l GROUP BY 1)
SELECT series_id, "window", rmse, mae, mape, n_zero, n_obs, {M} AS mase_m, round(den, 4) AS mase_denominator, round(raw / nullif(den, 0), 4) AS mase FROM m JOIN d USING (series_id)""",
    "mape_zero_guard": f"WITH t AS (SELECT event_type AS series_id, floor(value / 40)::DOUBLE AS a, floor(value / 40)::DOUBLE - value / 40 AS e FROM events) SELECT series_id, {_METRIC} FROM t GROUP BY 1",
    "residual_moments": f"{_SLICE} SELECT series_id, count(*) AS n, round(avg(residual), 6) + 0 AS residual_mean, round(coalesce(stddev_samp(residual), 0), 6) AS residual_std FROM fits GROUP BY 1",
    "residual_acf": f"{_SLICE}, {_CLEAN}, {_ACF} SELECT series_id, lag, n, max_lag, round(acf, 6) AS acf FROM rho WHERE lag <= max_lag",
    "key_lags": f"{_SLICE}, {_CLEAN}, {_ACF} SELECT series_id, lag, lag <= max_lag AS computed, CASE WHEN lag <= max_lag THEN round(acf, 6) END AS acf FROM rho WHERE lag IN (1, {M})",
    "ljung_box_stat": f"{_SLICE}, {_CLEAN}, {_ACF} SELECT series_id, n, greatest(1, least({2 * M}, n // 5)) AS ljung_box_lags, round(sum(acf * acf / (n - lag)) * n * (n + 2), 4) AS ljung_box_stat FROM rho WHERE n > 15 AND lag <= greatest(1, least({2 * M}, n // 5)) GROUP BY 1, 2",
    "residual_pacf": f"WITH RECURSIVE {_SLICE[5:]}, {_CLEAN}, {_ACF}, {_PACF} SELECT series_id, k::INT AS lag, round(a, 6) AS pacf FROM lev WHERE k > 0",
    "diagnostics_rows": f"""{_SLICE}, {_CLEAN}, {_ACF}, mom AS (SELECT series_id, count(*) AS n, avg(residual) AS mu, coalesce(stddev_samp(residual), 0) AS sd FROM fits GROUP BY 1),
box AS (SELECT series_id, n, greatest(1, least({2 * M}, n // 5)) AS depth, sum(acf * acf / (n - lag)) * n * (n + 2) AS stat FROM rho WHERE n > 15 AND lag <= greatest(1, least({2 * M}, n // 5)) GROUP BY 1, 2, 3),
lines AS (SELECT series_id, n, 'summary' AS section, 'residual_mean' AS statistic, NULL::INT AS lag, NULL AS lag_units, mu AS value, NULL AS note FROM mom
  UNION ALL SELECT series_id, n, 'summary', 'residual_std', NULL, NULL, sd, NULL FROM mom
  UNION ALL SELECT series_id, n, 'acf', 'acf', lag, 'observations', CASE WHEN lag <= max_lag THEN acf END,
    CASE WHEN lag > max_lag THEN 'key lag ' || lag || ' exceeds max_lag=' || max_lag || ' (n=' || n || ' residuals)' END FROM rho WHERE lag <= max_lag OR lag IN (1, {M})
  UNION ALL SELECT series_id, n, 'ljung_box', 'ljung_box_stat', NULL, NULL, stat, NULL FROM box
  UNION ALL SELECT series_id, n, 'ljung_box', 'ljung_box_lags', NULL, 'observations', depth, NULL FROM box
  UNION ALL SELECT DISTINCT series_id, n, 'params', 'max_lag', NULL::INT, 'observations', max_lag::DOUBLE, NULL FROM lags
  UNION ALL SELECT series_id, n, 'params', 'min_acf_pairs', NULL, NULL, 30, NULL FROM mom)
SELECT series_id, 'baseline' AS model_name, section, statistic, lag, lag_units, round(value, 6) + 0 AS value, CASE WHEN value IS NULL THEN 'not_computed' ELSE 'ok' END AS status, note, 'W-MON' AS freq_alias, {M} AS m, n FROM lines""",
    "block_resample": f"{_SLICE}, train AS (SELECT series_id, pos, residual FROM fits UNION ALL SELECT 'first' || k, pos, residual FROM fits, (VALUES (5), (13), (14), (15)) AS v(k) WHERE pos < k), {_draw_sql(50)} SELECT series_id, sim, pos, round(e, 4) AS e FROM e",
    "bootstrap_ci_quantile": f"{_FULL} SELECT t.ds, split, round(y, 4) AS y, round(yhat, 4) AS yhat, round(conf_lo, 4) AS conf_lo, round(conf_hi, 4) AS conf_hi FROM target t JOIN ci USING (series_id, ds)",
    "bootstrap_ci_sd": f"{_FULL} SELECT t.ds, split, round(y, 4) AS y, round(yhat, 4) AS yhat, round(yhat - 1.959963984540054 * sd, 4) AS conf_lo, round(yhat + 1.959963984540054 * sd, 4) AS conf_hi FROM target t JOIN ci USING (series_id, ds)",
    "excess_obs": f"""{_FULL} SELECT series_id, t.ds AS "date", round(y, 4) AS observed, round(yhat, 4) AS expected, round(conf_lo, 4) AS expected_ci_lo, round(conf_hi, 4) AS expected_ci_hi, round(y - yhat, 4) AS excess,
  round(e_lo, 4) AS excess_ci_lo, round(e_hi, 4) AS excess_ci_hi, round((y - yhat) / yhat * 100, 4) AS excess_pct, round(least(e_lo / yhat, e_hi / yhat) * 100, 4) AS excess_pct_ci_lo, round(greatest(e_lo / yhat, e_hi / yhat) * 100, 4) AS excess_pct_ci_hi
  FROM target t JOIN ci USING (series_id, ds) WHERE t.ds >= ev""",
    "excess_period_days": f"{_FULL}, {_periods_sql([(1, 'First quarter', 'days', 0, 90), (2, 'Later', 'days', 91, None)])} {_PERIOD_OUT}",
    "excess_period_obs": f"{_FULL}, {_periods_sql([(1, 'First 4', 'obs', 0, 3), (2, 'From 10', 'obs', 10, None)])} {_PERIOD_OUT}",
    "ate_summary": f"{_FULL}, {_periods_sql([])} {_ATE_OUT}",
    "batch_ate": f"""WITH s AS (SELECT l_returnflag AS series_id, date_trunc('week', l_shipdate)::TIMESTAMP AS ds, sum(l_quantity)::DOUBLE AS y FROM lineitem GROUP BY 1, 2),
gaps AS (SELECT series_id, epoch(ds - lag(ds) OVER (PARTITION BY series_id ORDER BY ds)) AS g FROM s),
ok AS (SELECT series_id FROM gaps GROUP BY 1 HAVING min(g) = max(g)), weekly AS (SELECT s.* FROM s JOIN ok USING (series_id)), {_splits_sql()}, {_BASE}, {_boot_sql(100)}, {_periods_sql([])} {_ATE_OUT}""",
}
