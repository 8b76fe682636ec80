"""Special functions on plain NumPy: chi-square tails, Shapiro-Wilk, partial autocorrelation, seeds."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def chi2_sf(x: float, k: float) -> float:
    """P(X > x) for chi-square with ``k`` degrees: regularised incomplete gamma by series or continued fraction."""
    if not (math.isfinite(x) and k > 0):
        return math.nan
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def shapiro_wilk(values) -> tuple[float, float]:
    """(W, p) after Royston (1995), for 3 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("Shapiro-Wilk needs 3 to 5000 values")
    if x[-1] - x[0] < 1e-19:
        return 1.0, 1.0
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(ssq)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # Royston's polynomials for the largest weights.
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(ssq)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(ssq)], u)
            phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    d = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(d @ d))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        # Royston's fits of the transformed statistic, small samples.
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        # The same for larger samples, in log n.
        ln = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, 1 - _NORMAL.cdf((y - mean) / sd)


def acf(x: np.ndarray, max_lag: int) -> np.ndarray:
    """Biased autocorrelations of lags 1 .. max_lag; all 0 for a constant."""
    d = x - x.mean()
    c0 = float(d @ d)
    return np.array([float(d[:-k] @ d[k:]) / c0 if c0 else 0.0 for k in range(1, max_lag + 1)])


def pacf_yule_walker(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations of lags 1 .. k, by Levinson's recursion."""
    out, phi, v = [], np.empty(0), 1.0
    for k, rk in enumerate(r):
        a = (rk - float(phi @ r[:k][::-1])) / v if v > 0 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        v *= 1 - a * a
        out.append(a)
    return np.array(out)


def order_statistic_medians(n: int) -> np.ndarray:
    """Uniform order-statistic medians (Filliben), for a normal probability plot."""
    p = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    p[-1] = 0.5 ** (1 / n)
    p[0] = 1 - p[-1]
    return p


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    return np.array([_NORMAL.inv_cdf(v) for v in p])


def derive_seed(global_seed: int, *markers) -> int:
    """A non-negative 32-bit seed from the global one and the markers, by xxh32."""
    import xxhash

    return xxhash.xxh32("|".join(map(str, (global_seed, *markers)))).intdigest()
