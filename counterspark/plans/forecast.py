"""Fits and simulations as Spark jobs.

Fits run one group per series.  Simulations are rows of a (series, chunk) table: each
series' short arrays are exploded into chunks of simulation numbers after they are
built, so training rows are never shuffled once per simulation, and a chunk is the
unit that is lost and redone with an executor.
"""

from __future__ import annotations

import json
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.registry import make_model, model_class
from ..operators.bootstrap import resample_blocks

FIT_SCHEMA = "series_id string, model string, pos int, ds timestamp_ntz, y double, split string, intervention_ts timestamp_ntz, fitted double, residual double, yhat double, state string, metadata string, notes string, error string"
SIMS_PER_TASK = 50


def _frame(pdf: pd.DataFrame, cols: list[str]) -> pd.DataFrame:
    return pdf.sort_values("pos", kind="stable").reset_index(drop=True)[["pos", "ds", "y", "split", "intervention_ts", *cols]]


def fit_one(rows: pd.DataFrame, model_name: str, params: dict, m: int | None, cols: list[str]) -> pd.DataFrame:
    """Fit on train rows, predict test and holdout; columns of FIT_SCHEMA but series_id and model."""
    out = rows[["pos", "ds", "y", "split", "intervention_ts"]].copy()
    for c in ("fitted", "residual", "yhat"):
        out[c] = np.nan
    out["state"] = out["metadata"] = out["notes"] = out["error"] = None
    train, target = rows["split"] == "train", rows["split"].isin(["test", "holdout"])
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        try:
            model = make_model(model_name, params, {"seasonal_period": m})
            r = model.fit(rows[train], covariate_cols=cols)
            out.loc[train, "fitted"], out.loc[train, "residual"] = r.fitted_values, r.residuals
            if target.any():
                out.loc[target, "yhat"] = model.predict(rows[target], covariate_cols=cols).predicted
            out["state"], out["metadata"] = json.dumps(model.state), json.dumps(r.metadata)
        except Exception as e:  # one series' failure is its own row, not the batch's
            out["error"] = f"{type(e).__name__}: {e}"
    out["notes"] = "\n".join(dict.fromkeys(str(w.message) for w in caught if issubclass(w.category, UserWarning))) or None
    return out


def fit_series(splits: DataFrame, model_name: str, params: dict, m: int | None = None, covariate_cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per train, test and holdout row of every series (FIT_SCHEMA).

    ``m``: seasonal period if it is the same for all series; else a column ``m`` of ``splits``.
    """
    model_class(model_name)
    cols = list(covariate_cols or [])
    own_m = "m" in splits.columns
    used = splits.where("split <> 'unused'").select("series_id", "pos", "ds", "y", "split", "intervention_ts", *(["m"] if own_m else []), *cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        period = (None if pd.isna(pdf["m"].iloc[0]) else int(pdf["m"].iloc[0])) if own_m else m
        out = fit_one(_frame(pdf, cols), model_name, params, period, cols)
        out.insert(0, "series_id", pdf["series_id"].iloc[0])
        out.insert(1, "model", model_name)
        return out

    return used.groupBy("series_id").applyInPandas(run, FIT_SCHEMA)


SIM_SCHEMA = "series_id string, sim int, pos int, ds timestamp_ntz, yhat_sim double, ok boolean"


def simulate(fits: DataFrame, splits: DataFrame, model_name: str, params: dict, n_sim: int, block_length: int = 14, seed=42, covariate_cols: list[str] | None = None, per_task: int = SIMS_PER_TASK) -> DataFrame:
    """(series_id, sim, pos, ds, yhat_sim, ok): refits on block-resampled residuals.

    A failed simulation has ``ok`` false and null predictions.  ``seed`` is a number
    or a column of ``fits`` (per-series seeds).
    """
    cols = list(covariate_cols or [])
    seed_col = F.col(seed) if isinstance(seed, str) else F.lit(int(seed)).cast("bigint")
    rows = fits.where("error is null")
    if cols:
        rows = rows.join(splits.select("series_id", "pos", *cols), ["series_id", "pos"])
    item = F.struct("pos", "ds", "y", "split", "fitted", "residual", *cols)
    arrays = rows.groupBy("series_id").agg(F.sort_array(F.collect_list(item)).alias("rows"), F.first("state").alias("state"), F.first(seed_col).alias("seed"))
    n_chunks = -(-n_sim // per_task)
    work = arrays.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    work = work.repartition(max(n_chunks, int(fits.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "series_id", "chunk")

    def run(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield _simulate_chunk(r, model_name, params, n_sim, per_task, block_length, cols)

    return work.mapInPandas(run, SIM_SCHEMA)


def _simulate_chunk(r, model_name, params, n_sim, per_task, block_length, cols) -> pd.DataFrame:
    data = pd.DataFrame([x.asDict() if hasattr(x, "asDict") else dict(x) for x in r.rows])
    train, target = data[data["split"] == "train"].copy(), data[data["split"].isin(["test", "holdout"])]
    warm = train["residual"].notna().to_numpy()  # rows without a fit are not in the pool
    fitted, pool = train["fitted"].to_numpy(dtype=float), train["residual"].to_numpy(dtype=float)[warm]
    train = train[warm]
    seeds = np.random.default_rng(int(r.seed)).integers(0, 2**31, size=n_sim)
    out = []
    base = make_model(model_name, params, json.loads(r.state))
    for sim in range(r.chunk * per_task, min(n_sim, (r.chunk + 1) * per_task)):
        one = pd.DataFrame({"series_id": r.series_id, "sim": sim, "pos": target["pos"].to_numpy(), "ds": target["ds"].to_numpy()})
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                e = resample_blocks(pool, block_length, np.random.default_rng(int(seeds[sim])))
                model = base.clone_fresh()
                model.fit(train.assign(y=fitted[warm] + e), covariate_cols=cols)
                yhat = np.asarray(model.predict(target, covariate_cols=cols).predicted, dtype=float)
            one["yhat_sim"], one["ok"] = np.where(np.isfinite(yhat), yhat, np.nan), True
        except Exception:
            one["yhat_sim"], one["ok"] = np.nan, False
        out.append(one)
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in SIM_SCHEMA.split(", ")})


def null_nan(df: DataFrame, *cols: str) -> DataFrame:
    """NaN to null in ``cols``: what leaves Python must not enter an aggregate as NaN."""
    for c in cols:
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df
