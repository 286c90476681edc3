"""Quantiles of Student's t, for a handful of degrees of freedom at a time."""

from __future__ import annotations

import math


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x)
                     + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def t_quantile(p: float, df: int) -> float:
    """x with P(T <= x) = p for p >= 0.5, by bisection."""
    def upper_tail(t):
        return 0.5 * _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    low, high = 0.0, 1.0
    while upper_tail(high) > 1.0 - p:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if upper_tail(middle) > 1.0 - p else (low, middle)
    return (low + high) / 2.0
