"""Tail probabilities of reduced test statistics."""

from __future__ import annotations

import math


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def beta_regularised(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def f_upper_tail(f, df1, df2) -> float | None:
    """P(F > f) for df1 and df2 degrees of freedom; None when undefined."""
    if any(v is None or math.isnan(v) for v in (f, df1, df2)):
        return None
    if f <= 0:
        return 1.0
    return beta_regularised(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def normal_two_sided(z: float) -> float:
    """P(|Z| > |z|) for a standard normal Z."""
    return math.erfc(abs(z) / math.sqrt(2.0))


# Fixed value: 97.5 % point of the standard normal distribution.
NORMAL_975 = 1.959963984540054
