"""Trend-and-season curve plus boosted trees on its residuals (``prophet_xgb``).

Stage A: piecewise-linear trend with 25 possible changes over the first part of the
training span, yearly and weekly Fourier terms; the changes have a sparse (Laplace)
prior, fitted by reweighted ridge.  Stage B: boosted trees on calendar features and
covariates.  Covariates enter stage B only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .base import BaseModel, FitResult, PredictionResult, covariates, days, fourier, resolve_weekly, resolve_yearly
from .boosting import HistogramBoosting

N_CHANGES = 25
YEARLY_ORDER, WEEKLY_ORDER = 10, 3


def time_features(dates) -> np.ndarray:
    d = pd.DatetimeIndex(pd.to_datetime(dates))
    return np.column_stack([d.dayofweek, d.dayofyear, d.month, d.isocalendar().week.to_numpy(dtype=int)]).astype(float)


class HybridModel(BaseModel):
    name = "prophet_xgb"

    def _design(self, t: np.ndarray) -> np.ndarray:
        z = (t - self.t0) / self.span
        parts = [np.ones((len(t), 1)), z[:, None], np.maximum(0.0, z[:, None] - self.changes)]
        if self.yearly:
            parts.append(fourier(t, 365.25, YEARLY_ORDER))
        if self.weekly:
            parts.append(fourier(t, 7.0, WEEKLY_ORDER))
        return np.hstack(parts)

    def fit(self, train_df, target_col="y", date_col="ds", covariate_cols=()):
        p = self.params.get("prophet", {})
        t, y = days(train_df[date_col]), train_df[target_col].to_numpy(dtype=float)
        ok = np.isfinite(y)
        self.t0, self.span = float(t.min()), max(1e-9, float(t.max() - t.min()))
        self.yearly = resolve_yearly(p.get("yearly_seasonality", "auto"), t[ok])
        self.weekly = resolve_weekly(p.get("weekly_seasonality", "auto"), t[ok])
        k = min(N_CHANGES, max(0, int(ok.sum() * 0.8) - 1))
        self.changes = np.linspace(0, float(p.get("changepoint_range", 0.8)), k + 1)[1:] if k else np.empty(0)
        x = self._design(t)
        scale = float(np.abs(y[ok]).max()) or 1.0
        xs, ys = x[ok], y[ok] / scale
        cps, sps = float(p.get("changepoint_prior_scale", 0.05)), float(p.get("seasonality_prior_scale", 10.0))
        n_season = x.shape[1] - 2 - k
        prior = np.concatenate([[1 / 25.0] * 2, np.full(k, 1 / (2 * cps**2)), np.full(n_season, 1 / sps**2)])
        sigma2, beta = float(np.var(ys)) or 1e-6, None
        xtx, xty = xs.T @ xs, xs.T @ ys
        for _ in range(8):  # Laplace prior as a sequence of normal ones
            beta = np.linalg.solve(xtx + sigma2 * np.diag(prior) + 1e-10 * np.eye(len(prior)), xty)
            sigma2 = max(1e-10, float(np.mean((ys - xs @ beta) ** 2)))
            prior[2:2 + k] = 1 / (cps * np.maximum(np.abs(beta[2:2 + k]), 1e-4))
        self.beta = beta * scale
        base = x @ self.beta
        self.boost = HistogramBoosting(**self.params.get("xgb", {}))
        features = np.hstack([time_features(train_df[date_col]), covariates(train_df, covariate_cols)])
        self.boost.fit(features[ok], (y - base)[ok])
        fit = base + self.boost.predict(features)
        self.fitted = True
        return FitResult(fit, y - fit, self, {"yearly": self.yearly, "weekly": self.weekly})

    def predict(self, target_df, target_col="y", date_col="ds", covariate_cols=()):
        self._need_fit()
        features = np.hstack([time_features(target_df[date_col]), covariates(target_df, covariate_cols)])
        out = self._design(days(target_df[date_col])) @ self.beta + self.boost.predict(features)
        return PredictionResult(pd.DatetimeIndex(target_df[date_col]), out)
