"""Exact test p-values.

They run as Arrow UDFs over aggregated results (one row per gene set, measure or person set), not
over variants or persons.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_regularized(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        for _ in range(100_000):
            n += 1.0
            term *= x / n
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - total * front
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return beta_regularized(n - k, k + 1.0, 1.0 - p)


def _binomial_logpmf(k: int, n: int, p: float) -> float:
    if p <= 0.0:
        return 0.0 if k == 0 else -math.inf
    if p >= 1.0:
        return 0.0 if k == n else -math.inf
    return (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact test: total probability of outcomes at most as likely as ``k``."""
    if k > n:
        return math.nan
    limit = _binomial_logpmf(k, n, p) + math.log1p(1e-7)
    mean = n * p
    if k == mean:
        return 1.0
    if k < mean:
        low, high = math.ceil(mean), n + 1  # first likely-enough-or-less outcome on the right
        while low < high:
            mid = (low + high) // 2
            if _binomial_logpmf(mid, n, p) <= limit:
                high = mid
            else:
                low = mid + 1
        return min(1.0, binomial_cdf(k, n, p) + 1.0 - binomial_cdf(low - 1, n, p))
    low, high = -1, math.floor(mean)  # last such outcome on the left
    while low < high:
        mid = (low + high + 1) // 2
        if mid < 0 or _binomial_logpmf(mid, n, p) <= limit:
            low = mid
        else:
            high = mid - 1
    return min(1.0, binomial_cdf(low, n, p) + 1.0 - binomial_cdf(k - 1, n, p))


def poisson_two_sided(observed: float, expected: float) -> float:
    """Twice the tail on the side of the observation, at most 1."""
    def cdf(k: float) -> float:
        return 0.0 if k < 0 else gamma_upper(math.floor(k) + 1.0, expected)
    tail = 1.0 - cdf(observed - 1) if observed >= expected else cdf(observed)
    return min(2.0 * tail, 1.0)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided Student t tail probability."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_regularized(df / 2.0, 0.5, df / (df + t * t))


def _number(value: float | None) -> bool:
    return value is not None and not (isinstance(value, float) and math.isnan(value))


@pandas_udf(DoubleType())
def binomial_test(observed: pd.Series, count: pd.Series, probability: pd.Series) -> pd.Series:
    """p-value of ``observed`` hits in ``count`` events; no hits give 1."""
    return pd.Series([
        None if not _number(p) else 1.0 if k == 0 else binomial_two_sided(int(k), int(n), float(p))
        for k, n, p in zip(observed, count, probability)], dtype="float64")


@pandas_udf(DoubleType())
def poisson_test(observed: pd.Series, expected: pd.Series) -> pd.Series:
    return pd.Series([
        poisson_two_sided(float(k), float(e)) if _number(e) else None
        for k, e in zip(observed, expected)], dtype="float64")


@pandas_udf(DoubleType())
def t_test(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        t_two_sided(float(v), float(d)) if _number(v) and _number(d) else None
        for v, d in zip(t, df)], dtype="float64")
