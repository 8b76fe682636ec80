"""Result tables as CSV files of exactly the names asked for (a run's reports are small)."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame


def _frame(x) -> pd.DataFrame:
    return x.toPandas() if isinstance(x, DataFrame) else x


def save_excess_table(obs, period, path, fmt: str = "csv") -> list[Path]:
    """Per-observation and per-period excess; empty ones are skipped."""
    path, parts = Path(path), {"Obs": _frame(obs), "Period": _frame(period)}
    parts = {k: v for k, v in parts.items() if len(v)}
    if fmt == "xlsx":
        path = path.with_suffix(".xlsx")
        with pd.ExcelWriter(path) as w:  # needs openpyxl
            for name, df in parts.items():
                df.to_excel(w, sheet_name=name, index=False)
        return [path]
    if fmt != "csv":
        raise ValueError(f"output format must be 'csv' or 'xlsx', got {fmt!r}.")
    out = []
    for name, df in parts.items():
        file = path if name == "Obs" else path.with_name(f"{path.stem}_period{path.suffix}")
        df.to_csv(file, index=False)
        out.append(file)
    return out


def save_metrics_table(metrics: dict[str, dict], path) -> Path:
    """One row per window, the window first."""
    names = ["rmse", "mae", "mape", "mase", "mase_m", "mase_denominator"]
    pd.DataFrame([{"window": w, **{k: m.get(k) for k in names}} for w, m in metrics.items()]).to_csv(path, index=False)
    return Path(path)


def save_ate_summary(ate, path) -> Path:
    _frame(ate).to_csv(path, index=False)
    return Path(path)


def save_diagnostics_table(diagnostics, path) -> Path:
    df = _frame(diagnostics).copy()
    for c in ("lag", "m", "n"):
        if c in df:
            df[c] = df[c].astype("Int64")
    df.to_csv(path, index=False)
    return Path(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Any size: a folder of CSV parts."""
    df.write.mode("overwrite").csv(path, header=True)
