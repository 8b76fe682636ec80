"""Trend plus seasonal means: the closed-form baseline of the native queries.

Not one of the forecasters users compare; it is this package's own yardstick.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .base import BaseModel, FitResult, PredictionResult


class TrendSeasonModel(BaseModel):
    name = "trend_season"

    def fit(self, train_df, target_col="y", date_col="ds", covariate_cols=()):
        y = train_df[target_col].to_numpy(dtype=float)
        n, m = len(y), int(self.params.get("m", 1))
        pos, ok = np.arange(n), np.isfinite(y)
        self.slope, self.intercept = np.polyfit(pos[ok], y[ok], 1) if ok.sum() > 1 else (0.0, float(y[ok].mean()))
        rest = y - self.intercept - self.slope * pos
        self.season = np.array([np.nanmean(rest[k::m]) if np.isfinite(rest[k::m]).any() else 0.0 for k in range(m)])
        self.n, self.fitted = n, True
        fit = self._at(pos)
        return FitResult(fit, y - fit, self, {"m": m})

    def _at(self, pos):
        return self.intercept + self.slope * pos + self.season[pos % len(self.season)]

    def predict(self, target_df, target_col="y", date_col="ds", covariate_cols=()):
        self._need_fit()
        return PredictionResult(pd.DatetimeIndex(target_df[date_col]), self._at(self.n + np.arange(len(target_df))))
