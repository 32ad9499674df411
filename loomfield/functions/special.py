"""Tail probabilities of Student's t and of F, for the few rows of a table of results."""

from __future__ import annotations

import math


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h * math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a


def p_of_t(t: float, df: float) -> float:
    """Two-sided."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def p_of_f(f: float, df1: float, df2: float) -> float:
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))
