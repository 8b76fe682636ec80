"""Many series in one plan: validate, prove the grid, split, fit, bootstrap, report.

Everything is keyed by ``series_id``.  A series that fails a check or a fit is a row
of ``errors``; the others go on.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as cfg
from ..functions.special import derive_seed
from ..operators import bootstrap, diagnostics, excess, frequency, impute, metrics, splits as sp, validate
from .forecast import fit_series, null_nan, simulate


@dataclass
class BatchResult:
    """Lazy relations, all keyed by series_id."""

    config: dict
    model_name: str
    errors: DataFrame
    notes: DataFrame
    frequency: DataFrame
    splits: DataFrame
    fits: DataFrame
    preds: DataFrame
    sims: DataFrame
    boot: DataFrame
    metrics: DataFrame
    obs_excess: DataFrame
    period_excess: DataFrame
    ate: DataFrame

    def unpersist(self) -> None:
        for df in (self.splits, self.fits, self.sims):
            df.unpersist()


def checked(series: DataFrame, specs: DataFrame, config: dict, split_method: str | None, covariate_cols: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, str, dict]:
    """(series that pass, errors, summary with frequency, method, its sizes)."""
    method, sizes = cfg.split_config(config["periods"], split_method)
    validate.validate_excess_periods(config.get("excess_periods"))
    policy = config["data"].get("missing_data", "error")
    found = validate.findings(validate.summarise(series, specs, covariate_cols), covariate_cols, method, **sizes)
    if policy == "error":
        gap = F.concat(F.col("n_missing").cast("string"), F.lit(" missing value(s) in the target; set missing_data to 'drop' or 'interpolate', or fill them."))
        found = found.withColumn("error", F.coalesce("error", F.when(F.col("n_missing") > 0, gap)))
        clean = series
    else:
        clean = impute.apply_missing(series, policy)
    freq = frequency.resolve_frequency(clean, detail=True).select("series_id", "alias", "m", F.col("error").alias("grid_error"))
    found = found.join(freq, "series_id", "left").withColumn("error", F.coalesce("error", "grid_error")).drop("grid_error")
    good = clean.join(found.where("error is null").select("series_id", "m"), "series_id")
    return good, found.where("error is not null").select("series_id", "error"), found, method, sizes


def run_batch(series: DataFrame, specs: DataFrame, model_name: str = "arima", config: dict | None = None, overrides: dict | None = None, split_method: str | None = None, seed: int = 42, per_series_seed: bool = True) -> BatchResult:
    """The whole analysis for every series of ``specs``.

    series: series_id, ds, y and the configured covariates; specs: series_id, intervention_ts.
    """
    conf = cfg.deep_merge(config or cfg.load_config(), overrides or {})
    cols = list(conf["data"].get("covariate_cols", []))
    good, errors, found, method, sizes = checked(series, specs, conf, split_method, cols)
    splits = sp.assign_splits(good, specs, method, **sizes)
    setting = conf["metrics"].get("seasonality", "auto")
    if setting != "auto":
        metrics.metrics_seasonality(setting, setting + 1 if isinstance(setting, int) else 2, None)  # its type and range
        n = splits.where("split = 'train'").groupBy("series_id").agg(F.count("*").alias("_n_train"))
        splits = splits.join(n, "series_id", "left").withColumn("_short", F.coalesce("_n_train", F.lit(0)) <= setting).persist(StorageLevel.MEMORY_AND_DISK)
        text = F.concat(F.lit(f"metrics.seasonality={setting} needs more than {setting} training rows, got "), F.coalesce("_n_train", F.lit(0)).cast("string"), F.lit("."))
        errors = errors.union(splits.where("_short").select("series_id", text.alias("error")).distinct())
        splits = splits.where("not _short").drop("_n_train", "_short")
    splits = splits.persist(StorageLevel.MEMORY_AND_DISK)
    params = cfg.model_config(conf, model_name)
    fits = fit_series(splits, model_name, params, covariate_cols=cols)
    fits = null_nan(fits, "y", "fitted", "residual", "yhat")
    if per_series_seed:
        mark = F.pandas_udf(lambda s: s.map(lambda x: derive_seed(seed, x)), "bigint")
        seeds = fits.select("series_id").distinct().withColumn("seed", mark("series_id"))
        fits = fits.join(seeds, "series_id")
    else:
        fits = fits.withColumn("seed", F.lit(seed).cast("bigint"))
    fits = fits.persist(StorageLevel.MEMORY_AND_DISK)
    b = conf["bootstrap"]
    sims = simulate(fits, splits, model_name, params, int(b["n_sim"]), bootstrap.fixed_block_length(int(b["block_length"])), "seed", cols)
    sims = null_nan(sims, "yhat_sim").persist(StorageLevel.MEMORY_AND_DISK)
    target = fits.where("split in ('test', 'holdout') and error is null").select("series_id", "pos", "ds", "y", "split", "intervention_ts", "yhat")
    preds = bootstrap.confidence(target, sims, ["series_id", "ds"], b["ci_method"], float(b["ci_level"]))
    boot = sims.groupBy("series_id").agg(F.countDistinct("sim").alias("n_sim"), F.countDistinct(F.when(F.col("ok"), F.col("sim"))).alias("n_successful"))
    return BatchResult(
        conf, model_name, errors.union(fits.where("error is not null").select("series_id", "error").distinct()),
        _notes(found, splits, fits, boot, conf), found.select("series_id", "alias", "m", "n_rows", "n_pre"), splits, fits, preds, sims, boot,
        window_metrics(splits, fits, conf), excess.excess_obs(preds, sims, float(b["ci_level"])),
        (period := excess.excess_period(preds, sims, conf.get("excess_periods"), float(b["ci_level"]))), excess.ate_summary(period),
    )


def _notes(found, splits, fits, boot, conf) -> DataFrame:
    """(series_id, note): what a single run would warn of."""
    model = fits.where("notes is not null").select("series_id", F.explode(F.split("notes", "\n")).alias("note")).distinct()
    window = sp.test_window_notes(splits, int(conf["periods"].get("min_test_obs", 30))).where("note is not null").select("series_id", "note")
    few = boot.where("n_successful < n_sim div 2").select("series_id", F.concat(F.lit("Only "), F.col("n_successful").cast("string"), F.lit(" bootstrap simulations succeeded.")).alias("note"))
    first = found.select("series_id", F.explode("warnings").alias("note"))
    span = fits.where("model = 'arima' and split = 'holdout'").groupBy("series_id").agg(F.datediff(F.max("ds"), F.min("ds")).alias("d")).where("d > 90")
    long = span.select("series_id", F.concat(F.lit("ARIMA forecasts over "), F.col("d").cast("string"), F.lit(" days tend to flatten; consider another model.")).alias("note"))
    out = first.union(model).union(window).union(few).union(long)
    if conf["metrics"].get("seasonality", "auto") == "auto":
        n = splits.where("split = 'train'").groupBy("series_id").agg(F.count("*").alias("n"), F.first("m").alias("m"))
        text = F.when(F.col("m").isNull(), "No dominant seasonal period is mapped for this frequency; MASE uses m=1.").when(
            F.col("n") < 2 * F.col("m"), F.concat(F.col("n").cast("string"), F.lit(" training rows are fewer than two cycles of m="), F.col("m").cast("string"), F.lit("; MASE uses m=1."))
        )
        out = out.union(n.select("series_id", text.alias("note")).where("note is not null"))
    return out


def window_metrics(splits: DataFrame, fits: DataFrame, conf: dict) -> DataFrame:
    """One row per series and window (train, test); an empty test window repeats train and says so.

    Training errors come from fitted values, so every forecaster is scored on the dates it fitted.
    """
    setting = conf["metrics"].get("seasonality", "auto")
    train = splits.where("split = 'train'")
    n = train.groupBy("series_id").agg(F.count("*").alias("n_train"), F.first("m").alias("m"))
    period = F.when(F.coalesce(F.col("n_train") < 2 * F.col("m"), F.lit(True)), F.lit(1)).otherwise(F.col("m")) if setting == "auto" else F.lit(int(setting))
    scale = metrics.seasonal_naive_mae(train.select("series_id", "ds", "y").join(n.select("series_id", period.alias("_period")), "series_id"), "_period")
    rows = fits.where("split in ('train', 'test') and error is null").withColumn("yhat", F.coalesce("yhat", "fitted"))
    per = metrics.error_metrics(rows, ["series_id", "model", "split"]).withColumnRenamed("split", "window")
    has = per.groupBy("series_id").agg(F.bool_or(F.col("window") == "test").alias("_t"))
    copy = per.join(has, "series_id").where("window = 'train' and not _t").drop("_t").withColumn("window", F.lit("test")).withColumn("substituted", F.lit(True))
    both = per.withColumn("substituted", F.lit(False)).unionByName(copy)
    return metrics.with_mase(both, scale)


def diagnostics_of(result: BatchResult, m: int | None, alias: str | None) -> DataFrame:
    return diagnostics.tidy(result.fits.where("split = 'train'"), result.model_name, m, alias)


def run_directory(output_dir: str | Path, n_sim: int) -> Path:
    """A new versioned folder run_{date}.v{NNN}_sim{n}; mkdir itself decides who gets a number."""
    base, day = Path(output_dir), date.today().isoformat()
    base.mkdir(parents=True, exist_ok=True)
    for v in range(1, 1000):
        path = base / f"run_{day}.v{v:03d}_sim{n_sim}"
        try:
            path.mkdir()
            return path
        except FileExistsError:
            continue
    raise RuntimeError("no free run number")


def new_run_folder(spark: SparkSession, output_dir: str, n_sim: int) -> str:
    """A new versioned folder run_{date}.v{NNN}_sim{n} on any filesystem Spark writes to.

    Whoever creates the folder's marker file has the number: creating it fails where it exists.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base, day = jvm.org.apache.hadoop.fs.Path(output_dir), date.today().isoformat()
    fs = base.getFileSystem(conf)
    for v in range(1, 1000):
        path = jvm.org.apache.hadoop.fs.Path(base, f"run_{day}.v{v:03d}_sim{n_sim}")
        if fs.exists(path):
            continue
        fs.mkdirs(path)
        if fs.createNewFile(jvm.org.apache.hadoop.fs.Path(path, "_RUN")):
            return str(fs.makeQualified(path).toString())
    raise RuntimeError("no free run number")


def save_batch(result: BatchResult, output_dir: str) -> str:
    """Partitioned Parquet of every relation under a new run folder, and the configuration; the folder's URI.

    ``output_dir`` is a path or URI that driver and executors share.
    """
    spark = result.errors.sparkSession
    path = new_run_folder(spark, str(output_dir), int(result.config["bootstrap"]["n_sim"]))
    for name in ("errors", "notes", "metrics", "obs_excess", "period_excess", "ate", "preds"):
        getattr(result, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(result.config),)], "value string").coalesce(1).write.text(f"{path}/config")
    return path
