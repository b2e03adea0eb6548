"""Upper tails of the t, F and chi-square distributions (continued fractions; no SciPy)."""

from __future__ import annotations

import math

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated front to back."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = c if abs(c) > _TINY else _TINY
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if not math.isfinite(t) or df <= 0:
        return 0.0 if math.isinf(t) else math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    """Regularised upper incomplete gamma at (df/2, x/2)."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = z + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h
