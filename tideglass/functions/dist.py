"""Distribution functions without SciPy: scalar and vectorised."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return _N.inv_cdf(p)


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    return np.array([norm_cdf(v) if v == v else math.nan for v in np.asarray(x, float).ravel()]).reshape(np.shape(x))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for m in range(500):
        if m == 0:
            num = 1.0
        elif m % 2 == 0:
            k = m // 2
            num = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            k = m // 2
            num = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: int) -> float:
    """For 1 and 2 degrees of freedom, in closed form."""
    if x <= 0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df == 2:
        return math.exp(-x / 2)
    raise ValueError("1 or 2 degrees of freedom")


def ks_uniform(u: np.ndarray) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance of a sample from the uniform law, and its asymptotic p-value."""
    u = np.sort(np.asarray(u, float))
    n = len(u)
    if not n:
        return math.nan, math.nan
    d = float(max((np.arange(1, n + 1) / n - u).max(), (u - np.arange(n) / n).max()))
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))
    return d, min(1.0, max(0.0, p)) if x > 0.2 else 1.0
