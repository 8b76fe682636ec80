"""One series: the batch plan with a single row of specs, raising instead of recording."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as cfg
from ..models.registry import model_class
from ..operators import diagnostics as diag
from ..operators import validate
from ..operators.frequency import SeriesFrequency
from ..sinks import plots, tables
from ..sources.series import ingest, specs
from .batch import BatchResult, run_batch


@dataclass
class PipelineResult:
    model_name: str
    batch: BatchResult
    series_frequency: SeriesFrequency
    metrics_train: dict
    metrics_test: dict
    obs_excess: pd.DataFrame
    period_excess: pd.DataFrame
    ate: pd.DataFrame
    diagnostics: pd.DataFrame
    config: dict

    def summary(self) -> str:
        """Human-readable text."""
        number = lambda v, s="": "n/a" if v is None or pd.isna(v) else f"{v:.4g}{s}"
        lines = [f"Model: {self.model_name}   frequency: {self.series_frequency.alias}"]
        for name, m in (("Train", self.metrics_train), ("Test", self.metrics_test)):
            lines.append(f"{name}: RMSE {number(m.get('rmse'))}, MAE {number(m.get('mae'))}, MAPE {number(m.get('mape'), '%')}, MASE {number(m.get('mase'))}")
        for r in self.period_excess.itertuples():
            lines.append(f"{r.period}: excess {number(r.total_excess)} [{number(r.excess_ci_lo)}, {number(r.excess_ci_hi)}], {number(r.excess_pct, '%')} over {r.n_obs} rows")
        return "\n".join(lines)


def run_single_its(df: DataFrame, intervention_date, target_col: str | None = None, date_col: str | None = None, covariate_cols: list[str] | None = None,
                   model_name: str = "prophet_xgb", config_path: str | None = None, config_overrides: dict | None = None, output_dir: str | None = None,
                   seed: int = 42, split_method: str | None = None) -> PipelineResult:
    """Counterfactual analysis of one series; errors raise, notes become warnings."""
    conf = cfg.load_config(config_path, config_overrides)
    d = conf["data"]
    d["covariate_cols"] = list(covariate_cols if covariate_cols is not None else d["covariate_cols"])
    date_col, target_col = date_col or d["date_col"], target_col or d["target_col"]
    model_class(model_name)
    validate.check_columns(df, intervention_date, date_col, target_col, d["covariate_cols"])
    validate.validate_excess_periods(conf.get("excess_periods"))
    series = ingest(df, date_col, target_col, d["covariate_cols"])
    spec = specs(df.sparkSession, [("series", str(intervention_date))])
    out = run_batch(series, spec, model_name, conf, split_method=split_method, seed=seed, per_series_seed=False)
    failed = out.errors.take(1)
    if failed:
        raise ValueError(failed[0]["error"])
    if series.isEmpty():
        raise ValueError("There are no rows to analyse.")
    for n in out.notes.select("note").distinct().collect():
        warnings.warn(n["note"], UserWarning, stacklevel=2)
    f = out.frequency.first()
    m = {r["window"]: r.asDict() for r in out.metrics.collect()}
    rows = lambda x, *by: x.drop("series_id").orderBy(*by).toPandas()  # noqa: E731  one series: some hundred rows
    result = PipelineResult(
        model_name, out, SeriesFrequency.from_alias(f["alias"]), m.get("train", {}), m.get("test", {}), rows(out.obs_excess, "date"),
        rows(out.period_excess, "period_no"), rows(out.ate, F.desc("metric")), rows(diag.tidy(out.fits.where("split = 'train'"), model_name, f["m"], f["alias"]), "section", "lag", "statistic"), conf,
    )
    p = result.diagnostics.query("statistic == 'ljung_box_pvalue'")["value"]
    if len(p) and p.iloc[0] < 0.05:
        warnings.warn(f"Residuals are autocorrelated (Ljung-Box p = {p.iloc[0]:.3g}); intervals may be too narrow.", UserWarning, stacklevel=2)
    if output_dir:
        save_run(result, output_dir)
    return result


def save_run(result: PipelineResult, output_dir: str) -> list[Path]:
    """The run's files: excess (and periods), metrics, diagnostics, ATE, and plots or their data."""
    path = Path(output_dir)
    path.mkdir(parents=True, exist_ok=True)
    files = tables.save_excess_table(result.obs_excess, result.period_excess, path / "excess.csv", result.config["output"].get("format", "csv"))
    files.append(tables.save_metrics_table({"train": result.metrics_train, "test": result.metrics_test}, path / "metrics.csv"))
    files.append(tables.save_diagnostics_table(result.diagnostics, path / "diagnostics.csv"))
    files.append(tables.save_ate_summary(result.ate, path / "ate_summary.csv"))
    files += plots.save_plots(result, path)
    return files
