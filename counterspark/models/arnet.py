"""Autoregressive network (``neuralprophet``): lags, trend, seasons and lagged covariates.

A linear net, or one with hidden layers, trained by Adam on mini-batches.  Forecasts
are recursive: a predicted step feeds the next, so what was observed after the event
never enters the counterfactual.  Warm-up rows have no fit (NaN).
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .base import BaseModel, FitResult, PredictionResult, covariates, days, fourier, resolve_weekly, resolve_yearly


class ArNetModel(BaseModel):
    name = "neuralprophet"

    def _calendar(self, t):
        z = (t - self.t0) / self.span
        parts = [z[:, None]]
        if self.yearly:
            parts.append(fourier(t, 365.25, 6))
        if self.weekly:
            parts.append(fourier(t, 7.0, 3))
        return np.hstack(parts)

    def _forward(self, x):
        acts = [x]
        for i, (w, b) in enumerate(self.layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if i < len(self.layers) - 1 else z)
        return acts

    def fit(self, train_df, target_col="y", date_col="ds", covariate_cols=()):
        p = self.params
        t, y, c = days(train_df[date_col]), train_df[target_col].to_numpy(dtype=float), covariates(train_df, covariate_cols)
        L = int(p.get("n_lags", 14))
        if len(y) <= L + 5:
            raise ValueError(f"neuralprophet: {len(y)} rows are too few for n_lags={L}.")
        if not np.isfinite(y).all():
            raise ValueError("neuralprophet: the target has missing values.")
        self.L, self.t0, self.span = L, float(t.min()), max(1e-9, float(t.max() - t.min()))
        self.yearly, self.weekly = resolve_yearly(p.get("yearly_seasonality", "auto"), t), resolve_weekly(p.get("weekly_seasonality", "auto"), t)
        self.mean, self.sd = float(y.mean()), float(y.std()) or 1.0
        self.c_mean, self.c_sd = c.mean(0), np.where(c.std(0) > 0, c.std(0), 1.0)
        u, cs = (y - self.mean) / self.sd, (c - self.c_mean) / self.c_sd
        rows = np.arange(L, len(y))
        back = rows[:, None] - np.arange(1, L + 1)
        x = np.hstack([u[back] if L else np.empty((len(rows), 0)), self._calendar(t)[rows], *([cs[rows - 1]] if c.shape[1] else [])])
        rng = np.random.default_rng(int(p.get("seed", 0)))
        hidden = [max(4, L)] * int(p.get("n_hidden_layers", 0) or 0)
        sizes = [x.shape[1], *hidden, 1]
        self.layers = [(rng.standard_normal((a, b)) * np.sqrt((2.0 if hidden else 0.1) / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
        goal = u[rows][:, None]
        flat = [v for layer in self.layers for v in layer]
        m1, m2 = [np.zeros_like(v) for v in flat], [np.zeros_like(v) for v in flat]
        step, size, epochs, rate = 0, int(p.get("batch_size", 64)), int(p.get("epochs", 100)), float(p.get("learning_rate", 0.01))
        for epoch in range(epochs):
            now = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)))
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), size):
                b = order[i:i + size]
                acts = self._forward(x[b])
                delta = 2 * (acts[-1] - goal[b]) / len(b)
                grads = []
                for j in range(len(self.layers) - 1, -1, -1):
                    grads = [acts[j].T @ delta, delta.sum(0)] + grads
                    if j:
                        delta = (delta @ self.layers[j][0].T) * (acts[j] > 0)
                step += 1
                for k, g in enumerate(grads):
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    flat[k] -= now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        fit = np.full(len(y), np.nan)
        fit[rows] = self._forward(x)[-1][:, 0] * self.sd + self.mean
        self.u, self.last_c, self.fitted = u, cs[-1:] if c.shape[1] else None, True
        return FitResult(fit, y - fit, self, {"n_lags": L, "yearly": self.yearly, "weekly": self.weekly})

    def predict(self, target_df, target_col="y", date_col="ds", covariate_cols=()):
        self._need_fit()
        cal = self._calendar(days(target_df[date_col]))
        c = covariates(target_df, covariate_cols)
        cs = np.vstack([self.last_c, (c - self.c_mean) / self.c_sd]) if c.shape[1] else None
        past, out = self.u.tolist(), []
        for i in range(len(target_df)):
            lag = np.array(past[:-self.L - 1:-1] if self.L else [])
            x = np.concatenate([lag, cal[i], *([cs[i]] if cs is not None else [])])
            v = float(self._forward(x[None, :])[-1][0, 0])
            past.append(v)
            out.append(v * self.sd + self.mean)
        return PredictionResult(pd.DatetimeIndex(target_df[date_col]), np.array(out))
