"""Tail probabilities that Spark SQL lacks, as Arrow functions over result rows.

They are applied after aggregation, to one row per test, never to fact rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t for p > 0.5, by bisection on the tail."""
    tail = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > tail:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def chi_square_upper(x: float, df: float) -> float:
    """Upper tail of chi-square: series below the mean, continued fraction above it."""
    if x <= 0.0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= z / n
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    result = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b or tiny)
        c = b + step / c or tiny
        result *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * result


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) or pd.isna(n) or n <= 0 else t_two_sided(x, n) for x, n in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(n) or n <= 0 else t_quantile(q, n) for q, n in zip(p, df)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2.0)) for x in z], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def chi_square_upper_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(v) or pd.isna(n) or n <= 0 else chi_square_upper(v, n) for v, n in zip(x, df)],
        dtype="float64",
    )
