"""What every model offers: fit on one series, predict further dates, start afresh.

Models run inside Spark tasks, one series (or simulation) at a time, on NumPy only.
``state`` carries what a refit must not search for again (an ARIMA order).
"""

from __future__ import annotations

import copy
import warnings
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

YEARLY_SPAN_DAYS = 730


@dataclass
class FitResult:
    fitted_values: np.ndarray
    residuals: np.ndarray
    model_object: object = None
    metadata: dict = field(default_factory=dict)


@dataclass
class PredictionResult:
    dates: pd.DatetimeIndex
    predicted: np.ndarray
    actual: np.ndarray | None = None


class BaseModel:
    name = "base"

    def __init__(self, params: dict | None = None, state: dict | None = None):
        self.params = copy.deepcopy(params or {})
        self.state = copy.deepcopy(state or {})
        self.fitted = False

    def fit(self, train_df: pd.DataFrame, target_col="y", date_col="ds", covariate_cols=()) -> FitResult:
        raise NotImplementedError

    def predict(self, target_df: pd.DataFrame, target_col="y", date_col="ds", covariate_cols=()) -> PredictionResult:
        raise NotImplementedError

    def clone_fresh(self) -> BaseModel:
        """An unfitted copy that shares nothing."""
        return type(self)(self.params, self.state)

    def _need_fit(self) -> None:
        if not self.fitted:
            raise RuntimeError(f"{self.name}: predict() needs a fitted model.")


def days(dates) -> np.ndarray:
    """Days since 1970 as floats."""
    return pd.DatetimeIndex(pd.to_datetime(dates)).to_numpy().astype("datetime64[ns]").astype(np.int64) / 86_400e9


def covariates(df: pd.DataFrame, cols) -> np.ndarray:
    return df[list(cols)].to_numpy(dtype=float) if len(list(cols)) else np.empty((len(df), 0))


def resolve_yearly(setting, t: np.ndarray, report: bool = True) -> bool:
    """Yearly seasonality: 'auto' needs a span of 730 days or more, and says how it decided."""
    if setting != "auto":
        return bool(setting)
    span = float(t.max() - t.min()) if len(t) else 0.0
    on = span >= YEARLY_SPAN_DAYS
    if report:
        warnings.warn(f"yearly_seasonality='auto' resolved to {'ENABLED' if on else 'DISABLED'}: the training span is {span:.0f} days, the rule needs {YEARLY_SPAN_DAYS}.", UserWarning, stacklevel=3)
    return on


def resolve_weekly(setting, t: np.ndarray) -> bool:
    """Weekly seasonality: 'auto' is off where rows are 7 days or more apart."""
    if setting != "auto":
        return bool(setting)
    return len(t) > 1 and float(np.diff(np.sort(t)).min()) < 7 and float(t.max() - t.min()) >= 14


def fourier(t: np.ndarray, period: float, order: int) -> np.ndarray:
    k = 2 * np.pi * np.arange(1, order + 1) / period
    return np.hstack([np.sin(t[:, None] * k), np.cos(t[:, None] * k)])
