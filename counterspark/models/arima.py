"""Seasonal ARIMA with regressors, by conditional least squares, and stepwise order search.

Differencing: KPSS tests for d, strength of the seasonal component for D.  The ARMA
part of the differenced series is fitted by Hannan-Rissanen and iterated
pseudo-linear regression; orders are compared by AICc from a stepwise search over
(p, q, P, Q).  A refit (``state`` has the order) searches nothing.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd

from .base import BaseModel, FitResult, PredictionResult, covariates


def resolve_m(setting, n_train: int, m: int | None, seasonal: bool = True) -> int:
    """The seasonal period: an explicit one stands (with a warning if short), 'auto' falls back to 1 with a warning."""
    if not seasonal:
        return 1
    if setting == "auto":
        if m is None:
            warnings.warn("No seasonal period is mapped for this frequency; ARIMA uses m=1.", UserWarning, stacklevel=3)
            return 1
        if n_train < 2 * m:
            warnings.warn(f"{n_train} training rows are fewer than two cycles of m={m}; ARIMA uses m=1.", UserWarning, stacklevel=3)
            return 1
        return m
    if isinstance(setting, bool) or not isinstance(setting, int) or setting < 1:
        raise ValueError(f"arima m must be 'auto' or an integer >= 1, got {setting!r}.")
    if n_train < 2 * setting:
        warnings.warn(f"{n_train} training rows are fewer than two cycles of m={setting}.", UserWarning, stacklevel=3)
    return setting


def kpss_rejects(x: np.ndarray) -> bool:
    """Whether level stationarity is rejected at 5 % (Kwiatkowski and others, 1992)."""
    n = len(x)
    e = x - x.mean()
    s = np.cumsum(e)
    lags = int(3 * np.sqrt(n) / 13)
    v = float(e @ e) / n
    for k in range(1, lags + 1):
        v += 2 * (1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) / n
    return v > 0 and float(s @ s) / (n**2 * v) > 0.463


def _difference(x: np.ndarray, d: int, D: int, m: int) -> np.ndarray:
    for _ in range(D):
        x = x[m:] - x[:-m]
    for _ in range(d):
        x = np.diff(x, axis=0)
    return x


def choose_differences(y: np.ndarray, m: int, max_d: int, max_D: int) -> tuple[int, int]:
    D = 0
    if m > 1 and max_D > 0 and len(y) >= 3 * m:
        k = np.ones(m) / m
        trend = np.convolve(y, k, mode="valid")
        rest = y[m // 2:m // 2 + len(trend)] - trend
        season = np.array([rest[i::m].mean() for i in range(m)])[np.arange(len(rest)) % m]
        total = float(np.var(rest))
        D = int(total > 0 and 1 - float(np.var(rest - season)) / total > 0.64)
    d = 0
    x = _difference(y, 0, D, m)
    while d < max_d and len(x) > 10 and kpss_rejects(x):
        x = np.diff(x)
        d += 1
    return d, D


def _lag_set(p: int, P: int, m: int) -> list[int]:
    """Lags with free weights: 1..p, and m, 2m .. Pm."""
    return sorted(set(range(1, p + 1)) | {k * m for k in range(1, P + 1)})


def _lagged(x: np.ndarray, lags: list[int]) -> np.ndarray:
    out = np.zeros((len(x), len(lags)))
    for j, k in enumerate(lags):
        if k < len(x):
            out[k:, j] = x[:-k]
    return out


def _innovations(w: np.ndarray, part: np.ndarray, ma: list[int], theta: np.ndarray) -> np.ndarray:
    """e = w - part - sum theta e[-k], from zeros."""
    e = (w - part).tolist()
    if not ma:
        return np.array(e)
    pairs = list(zip(ma, theta.tolist()))
    for i in range(len(e)):
        for k, c in pairs:
            if i >= k:
                e[i] -= c * e[i - k]
    return np.array(e)


def _stable(lags: list[int], weights: np.ndarray) -> bool:
    if not lags:
        return True
    poly = np.zeros(max(lags) + 1)
    poly[0] = 1
    poly[lags] = -weights
    return bool(np.abs(np.roots(poly)).max(initial=0) < 0.999)


def fit_arma(w: np.ndarray, x: np.ndarray, order: tuple[int, int, int, int], m: int, constant: bool) -> dict | None:
    """Conditional least squares of ``w`` on lags, innovations and regressors ``x``."""
    p, q, P, Q = order
    ar, ma = _lag_set(p, P, m), _lag_set(q, Q, m)
    n = len(w)
    fixed = np.hstack([np.ones((n, int(constant))), x])
    skip = max(ar, default=0)
    k = fixed.shape[1] + len(ar) + len(ma)
    if n - skip < k + 5:
        return None
    lags = _lagged(w, ar)
    e = np.zeros(n)
    if ma:  # innovations of a long autoregression, to start with
        depth = min(max(10, max(ma) + 2 if max(ma) <= 30 else 30), n // 4)
        long = np.hstack([np.ones((n, 1)), _lagged(w, list(range(1, depth + 1))), x])
        b = np.linalg.lstsq(long[depth:], w[depth:], rcond=None)[0]
        e[depth:] = (w - long @ b)[depth:]
    best = None
    for _ in range(4 if ma else 1):
        z = np.hstack([fixed, lags, _lagged(e, ma)])
        b = np.linalg.lstsq(z[skip:], w[skip:], rcond=None)[0]
        phi, theta = b[fixed.shape[1]:fixed.shape[1] + len(ar)], b[fixed.shape[1] + len(ar):]
        if not _stable(ma, -theta):
            theta = theta * 0.5 / max(0.5, float(np.abs(theta).sum()))
        e = _innovations(w, fixed @ b[:fixed.shape[1]] + lags @ phi, ma, theta)
        e[:skip] = 0.0
        sse = float(e[skip:] @ e[skip:])
        if np.isfinite(sse) and (best is None or sse < best["sse"]):
            best = {"sse": sse, "fixed": b[:fixed.shape[1]], "phi": phi, "theta": theta, "e": e.copy()}
    if best is None or not _stable(ar, best["phi"]):
        return None
    n_eff = n - skip
    s2 = max(best["sse"] / n_eff, 1e-300)
    free = k + 1
    best["aicc"] = n * np.log(s2) + 2 * free + (2 * free * (free + 1) / (n - free - 1) if n > free + 1 else np.inf)
    best |= {"ar": ar, "ma": ma, "constant": constant, "order": order}
    return best


class ArimaModel(BaseModel):
    name = "arima"

    def fit(self, train_df, target_col="y", date_col="ds", covariate_cols=()):
        y, x = train_df[target_col].to_numpy(dtype=float), covariates(train_df, covariate_cols)
        if not np.isfinite(y).all():
            raise ValueError("arima: the target has missing values.")
        prm = self.params
        if "order" in self.state:
            m, d, D = self.state["m"], self.state["d"], self.state["D"]
            orders = [tuple(self.state["order"])]
        else:
            m = resolve_m(prm.get("m", "auto"), len(y), self.state.get("seasonal_period"), bool(prm.get("seasonal", True)))
            d, D = choose_differences(y, m, int(prm.get("max_d", 2)), int(prm.get("max_D", 1)))
            orders = None
        w, xd = _difference(y, d, D, m), _difference(x, d, D, m)
        constant = d + D < 2
        if orders:
            found = fit_arma(w, xd, orders[0], m, constant) or fit_arma(w, xd, (0, 0, 0, 0), m, constant)
        else:
            found = self._search(w, xd, m, constant)
        if found is None:
            raise ValueError("arima: too few rows for any order.")
        self.m, self.d, self.D, self.found, self.y, self.x, self.w, self.xd = m, d, D, found, y, x, w, xd
        p, q, P, Q = found["order"]
        self.state |= {"order": list(found["order"]), "m": m, "d": d, "D": D}
        lost = d + D * m
        resid = np.zeros(len(y))
        resid[lost:] = found["e"]  # the rows that differencing takes fit themselves
        self.fitted = True
        meta = {"order": [p, d, q], "seasonal_order": [P, D, Q, m], "aicc": float(found["aicc"])}
        return FitResult(y - resid, resid, self, meta)

    def _search(self, w, xd, m, constant):
        prm = self.params
        top = (int(prm.get("max_p", 5)), int(prm.get("max_q", 5)), int(prm.get("max_P", 2)) if m > 1 else 0, int(prm.get("max_Q", 2)) if m > 1 else 0)
        tried: dict[tuple, dict | None] = {}

        def look(o):
            if o not in tried and all(0 <= v <= t for v, t in zip(o, top)):
                tried[o] = fit_arma(w, xd, o, m, constant)
            return tried.get(o)

        s = int(m > 1)
        start = [(2, 2, s, s), (0, 0, 0, 0), (1, 0, s, 0), (0, 1, 0, s)]
        best = None
        for o in start:
            o = tuple(min(v, t) for v, t in zip(o, top))
            f = look(o)
            if f and (best is None or f["aicc"] < best["aicc"]):
                best = f
        while best is not None:
            o, better = best["order"], None
            moves = [tuple(np.add(o, step)) for i in range(4) for step in (np.eye(4, dtype=int)[i], -np.eye(4, dtype=int)[i])]
            moves += [tuple(np.add(o, (a, a, 0, 0))) for a in (1, -1)] + [tuple(np.add(o, (0, 0, a, a))) for a in (1, -1)]
            for move in moves:
                f = look(tuple(int(v) for v in move))
                if f and f["aicc"] < (better or best)["aicc"]:
                    better = f
            if better is None:
                break
            best = better
        return best

    def predict(self, target_df, target_col="y", date_col="ds", covariate_cols=()):
        """Steps ahead from the end of training."""
        self._need_fit()
        h, f = len(target_df), self.found
        x = np.vstack([self.x, covariates(target_df, covariate_cols)])
        xd = _difference(x, self.d, self.D, self.m)[len(self.w):] if x.shape[1] else np.empty((h, 0))
        w, e = self.w.tolist(), f["e"].tolist()
        fixed = np.hstack([np.ones((h, int(f["constant"]))), xd]) @ f["fixed"]
        ar, ma = list(zip(f["ar"], f["phi"].tolist())), list(zip(f["ma"], f["theta"].tolist()))
        for i in range(h):
            n = len(w)
            w.append(float(fixed[i]) + sum(c * w[n - k] for k, c in ar if k <= n) + sum(c * e[n - k] for k, c in ma if k <= n))
            e.append(0.0)
        out = np.array(w[len(self.w):])
        # undo the differences, the last first
        levels = [self.y]
        for _ in range(self.D):
            levels.append(levels[-1][self.m:] - levels[-1][:-self.m])
        for _ in range(self.d):
            levels.append(np.diff(levels[-1]))
        for i in range(len(levels) - 2, -1, -1):
            step = self.m if i < self.D else 1
            past = levels[i].tolist()
            for v in out:
                past.append(past[-step] + float(v))
            out = np.array(past[len(levels[i]):])
        return PredictionResult(pd.DatetimeIndex(target_df[date_col]), out)
