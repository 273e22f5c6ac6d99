"""Student's t distribution in plain Python, for tables of distinct degrees of freedom.

With t = sqrt(df) * tan(a) the density becomes a power of cos(a), which is smooth: Gauss-Legendre
nodes integrate it for all degrees of freedom alike, and no special case is needed for large ones.
"""

from __future__ import annotations

from functools import lru_cache
from math import atan, exp, isfinite, lgamma, log, nan, pi, sqrt, tan

import numpy as np

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(120)


def _mass(angle: float, df: float) -> float:
    """Probability between 0 and t, for the t of this angle; long stretches in parts."""
    parts = 1 if angle * sqrt(df) < 8 else 4
    edges = np.linspace(0.0, angle, parts + 1)
    half = (edges[1] - edges[0]) / 2
    at = edges[:-1, None] + half * (1 + _NODES)
    total = float((np.exp((df - 1) * np.log(np.cos(at))) * _WEIGHTS).sum()) * half
    return exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * log(pi)) * total


def cdf(t: float, df: float) -> float:
    inner = _mass(atan(abs(t) / sqrt(df)), df)
    return 0.5 + (inner if t > 0 else -inner)


@lru_cache(maxsize=100_000)
def critical(df: float, alpha: float = 0.05) -> float:
    """Two-sided critical value, by halving the angle's interval; NaN for degrees of freedom that are none."""
    if not isfinite(df) or df <= 0:
        return nan
    wanted, low, high = (1 - alpha) / 2, 0.0, min(pi / 2, 60 / sqrt(df) if df > 2 else pi / 2)
    while low < (mid := (low + high) / 2) < high:
        low, high = (mid, high) if _mass(mid, df) < wanted else (low, mid)
    return sqrt(df) * tan(high)
