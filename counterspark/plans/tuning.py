"""Cross-validation, tuning and model comparison as flat Spark jobs.

Trials and folds are rows of one table: trials x folds fits run in parallel rather
than folds inside trials.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..models.arima import resolve_m
from ..models.registry import available_models, make_model, model_class
from ..operators import frequency, metrics, splits as sp
from ..sources.series import ingest, specs
from .single import run_single_its

# Search spaces (lowest, highest, kind, scale).
SEARCH_SPACES = {
    "arima": {
        "max_p": (1, 5, "int", "linear"), "max_d": (0, 2, "int", "linear"), "max_q": (1, 5, "int", "linear"),
        "max_P": (0, 3, "int", "linear"), "max_D": (0, 1, "int", "linear"), "max_Q": (0, 3, "int", "linear"),
    },
    "neuralprophet": {
        "n_lags": (7, 30, "int", "linear"), "epochs": (50, 200, "int", "linear"), "learning_rate": (0.001, 0.1, "float", "log"),
        "batch_size": (16, 128, "int", "linear"), "n_hidden_layers": (0, 2, "int", "linear"),
    },
    "prophet_xgb": {
        "prophet__changepoint_prior_scale": (0.01, 0.5, "float", "log"), "prophet__seasonality_prior_scale": (0.1, 10.0, "float", "log"),
        "prophet__changepoint_range": (0.4, 0.9, "float", "linear"), "xgb__n_estimators": (50, 500, "int", "linear"),
        "xgb__max_depth": (4, 20, "int", "linear"), "xgb__learning_rate": (0.001, 0.3, "float", "log"),
        "xgb__min_child_weight": (1, 12, "int", "linear"), "xgb__subsample": (0.6, 1.0, "float", "linear"),
        "xgb__colsample_bytree": (0.5, 1.0, "float", "linear"), "xgb__gamma": (0.001, 5.0, "float", "log"),
    },
}


@dataclass
class CVResult:
    model_name: str
    folds: pd.DataFrame
    summary_row: dict
    cv_end_date: str

    def summary(self) -> str:
        s = self.summary_row
        return f"{self.model_name}: {len(self.folds)} folds, RMSE {s['mean_rmse']:.4g} (sd {s['std_rmse']:.4g}), MAE {s['mean_mae']:.4g}, MAPE {s['mean_mape'] if s['mean_mape'] is not None else float('nan'):.4g}"


@dataclass
class TuningResult:
    model_name: str
    best_params: dict
    best_value: float
    trials: pd.DataFrame
    n_folds: int
    metric: str
    seed: int
    cv_end_date: str


def sample_lhs(space: dict, n: int, seed: int) -> list[dict]:
    """Latin hypercube: each parameter's range is cut in ``n`` strata, each used once."""
    rng = np.random.default_rng(seed)
    out = [{} for _ in range(n)]
    for name, (lo, hi, kind, scale) in space.items():
        u = (rng.permutation(n) + rng.random(n)) / n
        for i in range(n):
            v = math.exp(math.log(lo) + u[i] * (math.log(hi) - math.log(lo))) if scale == "log" else lo + u[i] * (hi - lo)
            out[i][name] = int(min(hi, max(lo, round(v)))) if kind == "int" else float(v)
    return out


def unflatten(flat: dict) -> dict:
    """``a__b`` keys to nested dicts."""
    out: dict = {}
    for key, value in flat.items():
        *head, last = key.split("__")
        at = out
        for h in head:
            at = at.setdefault(h, {})
        at[last] = value
    return out


def cv_scores(series: DataFrame, folds: DataFrame, models: DataFrame, m: int | None, covariate_cols: list[str] | None = None) -> DataFrame:
    """(trial, fold, rmse, mae, mape, mase, n_train, n_test, error) of every trial and fold of one series.

    models: trial, model, params (JSON).  ``m`` is fixed for all folds.
    """
    cols = list(covariate_cols or [])
    item = F.struct("pos", "ds", "y", *cols)
    rows = series.groupBy("series_id").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    work = rows.join(F.broadcast(folds)).join(F.broadcast(models))  # one series, a few folds, the trials
    spark = series.sparkSession
    work = work.repartition(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), "trial", "fold")

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([_score(r, m, cols) for r in batch.itertuples(index=False)], columns=["trial", "fold", "n_train", "n_test", "train_end_ds", "test_start", "test_end_ds", "rmse", "mae", "mape", "mase", "error"])

    schema = "trial int, fold int, n_train int, n_test int, train_end_ds timestamp_ntz, test_start timestamp_ntz, test_end_ds timestamp_ntz, rmse double, mae double, mape double, mase double, error string"
    return work.mapInPandas(run, schema)


def _score(r, m, cols):
    data = pd.DataFrame([x.asDict() if hasattr(x, "asDict") else dict(x) for x in r.rows])
    train, test = data[data["pos"] < r.train_end], data[(data["pos"] >= r.train_end) & (data["pos"] < r.test_end)]
    head = [r.trial, r.fold, len(train), len(test), train["ds"].iloc[-1], test["ds"].iloc[0], test["ds"].iloc[-1]]
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            model = make_model(r.model, json.loads(r.params), {"seasonal_period": m})
            model.fit(train, covariate_cols=cols)
            p = np.asarray(model.predict(test, covariate_cols=cols).predicted, dtype=float)
        a = test["y"].to_numpy(dtype=float)
        e = a - p
        if not np.isfinite(e).all():
            raise ValueError("predictions are not finite")
        mape = float(np.mean(np.abs(e / a)) * 100) if (a != 0).all() else None
        k = m or 1
        y = train["y"].to_numpy(dtype=float)
        naive = float(np.nanmean(np.abs(y[k:] - y[:-k]))) if len(y) > k else 0.0
        mae = float(np.abs(e).mean())
        return [*head, float(np.sqrt((e * e).mean())), mae, mape, mae / naive if naive else None, None]
    except Exception as ex:
        return [*head, None, None, None, None, f"{type(ex).__name__}: {ex}"]


def summarise_folds(scores: DataFrame) -> DataFrame:
    """Per trial: means and deviations over the folds that worked; none: infinite error."""
    inf = F.lit(float("inf"))
    return scores.groupBy("trial").agg(
        F.coalesce(F.avg("rmse"), inf).alias("mean_rmse"), F.coalesce(F.avg("mae"), inf).alias("mean_mae"), F.avg("mape").alias("mean_mape"),
        F.coalesce(F.stddev_samp("rmse"), F.when(F.count("rmse") == 1, 0.0)).alias("std_rmse"), F.coalesce(F.stddev_samp("mae"), F.when(F.count("mae") == 1, 0.0)).alias("std_mae"),
        F.count("rmse").alias("n_folds_ok"),
    )


def _prepare(df, intervention_date, conf, date_col, target_col, covariate_cols, cv_end_date, split_method, n_folds, sizes):
    """(rows with pos, folds, m, end date): the frame before the cap, and its folds."""
    d = conf["data"]
    cols = list(covariate_cols if covariate_cols is not None else d["covariate_cols"])
    series = ingest(df, date_col or d["date_col"], target_col or d["target_col"], cols)
    spec = specs(df.sparkSession, [("series", str(intervention_date))])
    if cv_end_date is None:
        method, args = cfg.split_config(conf["periods"])
        cv_end_date = sp.cv_end_date(series, spec, method, **args).first()["cv_end_date"]
    if pd.Timestamp(cv_end_date) > pd.Timestamp(str(intervention_date)):
        raise ValueError(f"cv_end_date {cv_end_date} is after the intervention {intervention_date}.")
    capped = series.where(F.col("ds") < F.lit(str(cv_end_date)).cast("timestamp_ntz"))
    f = frequency.resolve_frequency(capped, detail=True).first()
    if f is None:
        raise ValueError("No rows before cv_end_date.")
    n = f["n"]
    test, least, skip = sp.fold_sizes(n, split_method, n_folds, **sizes)
    folds = sp.fold_layout(df.sparkSession, n, n_folds, test, least, skip)
    from pyspark.sql import Window

    rows = capped.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy("ds")) - 1)
    return rows, folds, f, least, str(cv_end_date), cols


def _periods(f, model_name: str, params: dict, seasonality, least: int) -> tuple[int, dict]:
    """(MASE's period, the model's parameters), both fixed for all folds by the smallest training window.

    A period is asked of the grid only where it is not given; then the grid must be regular.
    ARIMA's own ``m`` and ``seasonal`` stand where the user set them.
    """
    asks = model_name == "arima" and params.get("m", "auto") == "auto" and bool(params.get("seasonal", True))
    if f["error"] and (asks or seasonality == "auto"):
        raise ValueError(f["error"])
    m = metrics.metrics_seasonality(seasonality, least, f["m"])
    return m, {**params, "m": resolve_m("auto", least, f["m"])} if asks else params


def _sizes(split_method, given: dict, defaults: dict) -> dict:
    if split_method == "days":
        raise ValueError("split_method='days' does not apply to cross-validation; folds are sized in rows.")
    known = {"percent": {"test_pct", "min_train_pct", "skip_pct"}, "observations": {"test_obs", "min_train_obs", "skip_obs"}}
    if split_method not in known:
        raise ValueError(f"split_method must be 'percent' or 'observations', got {split_method!r}.")
    foreign = [k for k, v in given.items() if v is not None and k not in known[split_method]]
    if foreign:
        raise ValueError(f"Arguments {foreign} do not apply to split_method={split_method!r}.")
    return {k: defaults[k] if given.get(k) is None else given[k] for k in known[split_method]}


def time_series_cv(df: DataFrame, intervention_date, model_name: str = "arima", n_folds: int = 5, test_obs=None, min_train_obs=None, skip_obs=None, cv_end_date=None,
                   split_method: str = "observations", test_pct=None, min_train_pct=None, skip_pct=None, date_col=None, target_col=None, covariate_cols=None,
                   config_path=None, config_overrides=None) -> CVResult:
    """Expanding-window cross-validation on rows before the run's own test window."""
    conf = cfg.load_config(config_path, config_overrides)
    model_class(model_name)
    given = {"test_obs": test_obs, "min_train_obs": min_train_obs, "skip_obs": skip_obs, "test_pct": test_pct, "min_train_pct": min_train_pct, "skip_pct": skip_pct}
    sizes = _sizes(split_method, given, {"test_obs": 90, "min_train_obs": 365, "skip_obs": 0, "test_pct": 0.10, "min_train_pct": 0.50, "skip_pct": 0.0})
    rows, folds, f, least, end, cols = _prepare(df, intervention_date, conf, date_col, target_col, covariate_cols, cv_end_date, split_method, n_folds, sizes)
    m, params = _periods(f, model_name, cfg.model_config(conf, model_name), conf["metrics"].get("seasonality", "auto"), least)
    spark = df.sparkSession
    models = spark.createDataFrame([(0, model_name, json.dumps(params))], "trial int, model string, params string")
    scores = cv_scores(rows, folds, models, m, cols).orderBy("fold").toPandas()
    ok = scores[scores["error"].isna()]
    if not len(ok):
        raise RuntimeError(f"All folds failed: {scores['error'].iloc[0]}")
    sd = lambda c: float(ok[c].std(ddof=1)) if len(ok) > 1 else 0.0
    summary = {"mean_rmse": ok["rmse"].mean(), "mean_mae": ok["mae"].mean(), "mean_mape": ok["mape"].mean() if ok["mape"].notna().any() else None, "std_rmse": sd("rmse"), "std_mae": sd("mae")}
    return CVResult(model_name, ok.drop(columns=["trial", "error"]), summary, end)


def tune_model(df: DataFrame, intervention_date, model_name: str, n_trials: int | None = None, n_folds: int | None = None, test_obs=None, min_train_obs=None, skip_obs=None, cv_end_date=None,
               split_method: str | None = None, test_pct=None, min_train_pct=None, skip_pct=None, metric: str | None = None, config_path=None, config_overrides=None, seed: int | None = None) -> TuningResult:
    """Latin-hypercube search; every trial and fold is one row of one job.

    What is not given comes from the configuration's ``tuning`` section.
    """
    conf = cfg.load_config(config_path, config_overrides)
    if model_name not in SEARCH_SPACES:
        raise ValueError(f"No search space for model {model_name!r}; known: {sorted(SEARCH_SPACES)}.")
    section = cfg.tuning_config(conf)
    n_trials = section["model_defaults"][model_name] if n_trials is None else n_trials
    n_folds = section.get("n_folds", 5) if n_folds is None else n_folds
    metric = section.get("metric", "rmse") if metric is None else metric
    seed = section.get("seed", 42) if seed is None else seed
    split_method = section["split_method"] if split_method is None else split_method
    if n_trials < 1:
        raise ValueError(f"n_trials must be >= 1, got {n_trials}.")
    if n_folds < 2:
        raise ValueError(f"n_folds must be >= 2, got {n_folds}.")
    if metric not in ("rmse", "mae"):
        raise ValueError(f"metric must be 'rmse' or 'mae', got {metric!r}.")
    given = {"test_obs": test_obs, "min_train_obs": min_train_obs, "skip_obs": skip_obs, "test_pct": test_pct, "min_train_pct": min_train_pct, "skip_pct": skip_pct}
    sizes = _sizes(split_method, given, {"test_obs": 365, "min_train_obs": 730, "skip_obs": 0, "test_pct": 0.10, "min_train_pct": 0.50, "skip_pct": 0.0} | {k: v for k, v in section.items() if v is not None})
    rows, folds, f, least, end, cols = _prepare(df, intervention_date, conf, None, None, None, cv_end_date, split_method, n_folds, sizes)
    sampled = sample_lhs(SEARCH_SPACES[model_name], n_trials, seed)
    m, base = _periods(f, model_name, cfg.model_config(conf, model_name), 1, least)  # trials are compared by errors without a period
    trials = [(i, model_name, json.dumps(cfg.deep_merge(base, unflatten(p)))) for i, p in enumerate(sampled)]
    models = df.sparkSession.createDataFrame(trials, "trial int, model string, params string")
    scored = summarise_folds(cv_scores(rows, folds, models, m, cols)).orderBy("trial").toPandas()
    flat = pd.DataFrame(sampled).assign(trial=range(n_trials))
    table = flat.merge(scored, on="trial")
    best = int(table[f"mean_{metric}"].to_numpy().argmin())  # the first of equals
    return TuningResult(model_name, unflatten(sampled[int(table["trial"].iloc[best])]), float(table[f"mean_{metric}"].iloc[best]), table, n_folds, metric, seed, end)


def compare_models(df: DataFrame, intervention_date, model_names: list[str] | None = None, target_col=None, date_col=None, covariate_cols=None, config_path=None, config_overrides=None, output_dir=None, seed: int = 42) -> pd.DataFrame:
    """One row per model: metrics and effect, or its error; the same seed for all."""
    out = []
    for name in model_names or available_models():
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                r = run_single_its(df, intervention_date, target_col, date_col, covariate_cols, name, config_path, config_overrides, f"{output_dir}/{name}" if output_dir else None, seed)
            total = r.ate.set_index("metric").loc["Total ATE"]
            row = {"model": name, **{f"{w}_{k}": d.get(k) for w, d in (("train", r.metrics_train), ("test", r.metrics_test)) for k in ("rmse", "mae", "mape", "mase")}, "ate": total["estimate"], "ate_ci_lo": total["ci_lo"], "ate_ci_hi": total["ci_hi"], "error": None}
            r.batch.unpersist()
        except Exception as e:
            row = {"model": name, "error": f"{type(e).__name__}: {e}"}
        out.append(row)
    return pd.DataFrame(out)
