"""Quantiles of Student's t, F and beta distributions, without a statistics library."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist


def log_beta_part(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - log_beta_part(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-30)
        c = 1 + t / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def beta_quantile(p: float, a: float, b: float) -> float:
    """The x at which the incomplete beta function is ``p``, by bisection."""
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if log_beta_part(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def f_quantile(p: float, d1: float, d2: float) -> float:
    """Quantile of the F distribution, through the beta distribution."""
    x = beta_quantile(p, d1 / 2, d2 / 2)
    return d2 * x / (d1 * (1 - x)) if x < 1 else math.inf


@lru_cache(maxsize=100_000)
def t_quantile(p: float, df: int) -> float:
    """Student's t quantile: through the beta distribution under 40 degrees of freedom, by the Cornish–Fisher
    expansion around the normal quantile from there on."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    if df < 40:
        x = beta_quantile(2 * (1 - p), df / 2, 0.5)
        return math.sqrt(df * (1 - x) / x) if x > 0 else math.inf
    z = NormalDist().inv_cdf(p)
    z2 = z * z
    g1 = (z2 + 1) * z / 4
    g2 = ((5 * z2 + 16) * z2 + 3) * z / 96
    g3 = (((3 * z2 + 19) * z2 + 17) * z2 - 15) * z / 384
    g4 = ((((79 * z2 + 776) * z2 + 1482) * z2 - 1920) * z2 - 945) * z / 92160
    return z + g1 / df + g2 / df**2 + g3 / df**3 + g4 / df**4


@lru_cache(maxsize=500_000)
def esd_limit(n: int, i: int, alpha: float) -> float:
    """Critical value of the ``i``-th step of the generalised extreme studentised deviate test of ``n`` values."""
    left = n - i + 1
    if left < 3:
        return math.inf
    t = t_quantile(1 - alpha / (2 * left), left - 2)
    return (left - 1) * t / math.sqrt((left - 2 + t * t) * left) if t < math.inf else (left - 1) / math.sqrt(left)
