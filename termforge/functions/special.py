"""Distribution functions needed by the tests and filters, written with NumPy and math alone.

All take and return plain floats (vectorise at the call site: they run on a handful of
values per group, never per row of a large table).
"""

from __future__ import annotations

import math

_TINY = 1e-300


def norm_cdf(x: float) -> float:
    """Standard normal distribution function."""
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function P(a, x)."""
    return 1.0 - gamma_q(a, x) if x >= a + 1.0 else _gamma_series(a, x)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x) = 1 - P(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return math.exp(log_gamma_q(a, x))


def _gamma_series(a: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while abs(term) > abs(total) * 1e-16:
        k += 1.0
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def log_gamma_q(a: float, x: float) -> float:
    """log Q(a, x) for x >= a + 1 by a continued fraction; exact where Q itself underflows."""
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return a * math.log(x) - x - math.lgamma(a) + math.log(h)


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    return gamma_q(df / 2.0, x / 2.0)


def chi2_log_sf(x: float, df: float) -> float:
    """Log of the upper tail, finite even where the tail underflows a double."""
    a, half = df / 2.0, x / 2.0
    return log_gamma_q(a, half) if half >= a + 1.0 else math.log(max(gamma_q(a, half), _TINY))


def chi2_ppf(p: float, df: float) -> float:
    """Quantile of the chi-square distribution, by bisection."""
    lo, hi = 0.0, max(1.0, df)
    while gamma_p(df / 2.0, hi / 2.0) < p:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if gamma_p(df / 2.0, mid / 2.0) < p else (lo, mid)
    return 0.5 * (lo + hi)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    def lift(v: float) -> float:
        return v if abs(v) > _TINY else _TINY

    c, d = 1.0, 1.0 / lift(1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 / lift(1.0 + num * d)
            c = lift(1.0 + num / c)
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def f_sf(x: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return 1.0 if x <= 0.0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x))


def t_sf2(x: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2.0, 0.5, df / (df + x * x))
