"""Many time series at once: ``(series keys, t, value)`` with one row per period.

Facts are summed to one row per series and period first, so a series is never longer than the
calendar, however many facts it has; windows over a series are bounded by that. ``t`` is calendar time:
a period without facts between the first and the last is a row with a missing value, and a lag
means the period so many steps before, not the row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stratapanel.functions.distributions import chi_square_upper_p


#: Whole number of a period, and the period so many steps on.
CALENDARS = {
    "year": (lambda p: F.year(p), lambda p, i: F.add_months(p, i * 12)),
    "month": (lambda p: F.year(p) * 12 + F.month(p), lambda p, i: F.add_months(p, i)),
    "day": (lambda p: F.unix_date(p), lambda p, i: F.date_add(p, i)),
    "number": (lambda p: p, lambda p, i: p + i),
}


def to_series(facts: DataFrame, keys: Sequence[str], period: Column, value: Column, unit: str = "month") -> DataFrame:
    """Aggregate facts to one row per period, ``t`` from 1 at the first one of the series.

    ``period`` is the start of a period as a date, or a whole number (``unit="number"``). Periods without facts up to the
    last one are added with a missing value: each row brings those that follow it, so nothing is joined.
    """
    number, further = CALENDARS[unit]
    sums = facts.groupBy(*keys, period.alias("period")).agg(value.alias("value"))
    order = Window.partitionBy(*keys).orderBy("period")
    at = number(F.col("period"))
    gap = F.coalesce(F.lead(at).over(order) - at, F.lit(1)).cast("int")
    placed = sums.withColumn("__gap", gap).withColumn("t", (at - F.min(at).over(Window.partitionBy(*keys)) + 1).cast("int"))
    rows = placed.where(F.col("period").isNotNull()).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__gap") - 1)))
    return rows.select(
        *keys, further(F.col("period"), F.col("__i")).alias("period"), F.when(F.col("__i") == 0, F.col("value")).alias("value"), (F.col("t") + F.col("__i")).alias("t")
    )


def split_at(series: DataFrame, last: object, period: str = "period") -> tuple[DataFrame, DataFrame]:
    """Training part up to ``last`` and test part after it."""
    return series.where(F.col(period) <= last), series.where(F.col(period) > last)


def explode_origins(series: DataFrame, first: int, last: int) -> DataFrame:
    """One copy of the history per origin: ``(keys, origin)`` becomes the series key."""
    origins = F.sequence(F.greatest(F.col("t"), F.lit(first)), F.lit(last))
    within = series.where(F.col("t") <= last)
    return within.withColumn("origin", F.explode(origins))


def gram(df: DataFrame, keys: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """Sums of all products of ``columns`` per series, as one flat upper triangle.

    Rows with a missing column drop out. Partial sums leave every task as one short array.
    """
    names = [f"__c{i}" for i in range(len(columns))]
    rows = df.select(*keys, *[c.alias(n) for c, n in zip(columns, names)]).dropna(subset=names)
    products = [
        F.sum(F.col(names[i]) * F.col(names[j])).alias(f"__s{i}_{j}")
        for i in range(len(names))
        for j in range(i, len(names))
    ]
    sums = rows.groupBy(*keys).agg(*products, F.count(F.lit(1)).alias("rows"))
    triangle = [f"__s{i}_{j}" for i in range(len(names)) for j in range(i, len(names))]
    return sums.select(*keys, "rows", F.array(*triangle).alias("gram"))


def full_matrix(triangle, size: int) -> np.ndarray:
    """Symmetric matrix from the flat upper triangle of ``gram``."""
    matrix = np.zeros((size, size))
    matrix[np.triu_indices(size)] = triangle
    return matrix + matrix.T - np.diag(np.diag(matrix))


def by_time(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("t")


def lag_of(value: str, k: int, keys: Sequence[str]) -> Column:
    """The value ``k`` periods before; missing if that period has no row or no value."""
    return F.max(value).over(by_time(keys).rangeBetween(-k, -k))


def autocorrelation(series: DataFrame, keys: Sequence[str], max_lag: int) -> DataFrame:
    """Autocorrelations as ``(keys, n, acf)`` with ``acf[k]`` at lag ``k``; lag 0 is 1.

    Of ``n`` known values those count that have a known partner ``k`` periods before. The sum over these pairs is divided by
    their number plus ``k``, which is ``n`` for a series without gaps.
    """
    centred = series.withColumn("__x", F.col("value") - F.avg("value").over(Window.partitionBy(*keys)))
    lagged = centred.select(*keys, "__x", *[lag_of("__x", k, keys).alias(f"__l{k}") for k in range(1, max_lag + 1)])
    sums = lagged.groupBy(*keys).agg(
        F.count("__x").alias("n"),
        F.avg(F.col("__x") * F.col("__x")).alias("__c0"),
        *[
            (F.sum(F.col("__x") * F.col(f"__l{k}")) / (F.count(F.col("__x") * F.col(f"__l{k}")) + k)).alias(f"__c{k}")
            for k in range(1, max_lag + 1)
        ],
    )
    ratios = [F.try_divide(f"__c{k}", "__c0") for k in range(max_lag + 1)]
    return sums.select(*keys, "n", F.array(*ratios).alias("acf"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _durbin_levinson(acf: pd.Series) -> pd.Series:
    """Partial autocorrelations at lags 1, 2, ... from autocorrelations at lags 0, 1, ..."""

    def one(r):
        if r is None or any(pd.isna(v) for v in r):
            return None
        phi, partial, spread = np.zeros(0), [], 1.0
        for k in range(1, len(r)):
            step = (r[k] - float(np.dot(phi, r[k - 1 : 0 : -1]))) / spread if spread > 0 else math.nan
            phi = np.append(phi - step * phi[::-1], step)
            spread *= 1.0 - step * step
            partial.append(float(step))
        return partial

    return acf.map(one)


def partial_autocorrelation(series: DataFrame, keys: Sequence[str], max_lag: int) -> DataFrame:
    acf = autocorrelation(series, keys, max_lag)
    return acf.select(*keys, "n", _durbin_levinson("acf").alias("pacf"))


def ljung_box(series: DataFrame, keys: Sequence[str], lags: int, fitted: Column | int = 0) -> DataFrame:
    """Portmanteau statistic of the first ``lags`` autocorrelations. ``fitted`` parameters, a number
    or an expression over the keys, reduce the degrees of freedom."""
    acf = autocorrelation(series, keys, lags)
    n = F.col("n").cast("double")
    terms = [F.col("acf")[k] * F.col("acf")[k] / (n - k) for k in range(1, lags + 1)]
    q = n * (n + 2) * sum(terms[1:], terms[0])
    stats = acf.select(*keys, q.alias("q"), (F.lit(lags) - fitted).alias("df"))
    return stats.withColumn("p_value", chi_square_upper_p(F.col("q"), F.col("df").cast("double")))


# Critical values of the unit-root test with constant and trend, by sample size
# (rows) and probability (columns), as published by Banerjee et al. (1993), table 4.2.
ADF_SIZES = [25, 50, 100, 250, 500, 100000]
ADF_PROBS = [0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99]
ADF_CRITICAL = [
    [-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15],
    [-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24],
    [-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28],
    [-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31],
    [-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32],
    [-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33],
]


def _adf_solver(size: int):
    @F.pandas_udf("statistic double, p_value double")
    def solve(gram_rows: pd.Series, rows: pd.Series, order: pd.Series) -> pd.DataFrame:
        out = []
        for triangle, n, k in zip(gram_rows, rows, order):
            # Columns: difference, level before, constant, time, lagged differences.
            full = full_matrix(triangle, size)
            used = list(range(1, 4 + int(k)))
            a, b, c = full[np.ix_(used, used)], full[used, 0], full[0, 0]
            free = n - len(used)
            if free <= 0 or np.linalg.matrix_rank(a) < len(used):
                out.append((None, None))
                continue
            inverse = np.linalg.inv(a)
            beta = inverse @ b
            variance = max(c - float(beta @ b), 0.0) / free
            if variance == 0.0:
                out.append((None, None))
                continue
            statistic = float(beta[0] / math.sqrt(variance * inverse[0, 0]))
            column = [np.interp(n + k, ADF_SIZES, [row[j] for row in ADF_CRITICAL]) for j in range(8)]
            out.append((statistic, float(np.interp(statistic, column, ADF_PROBS))))
        return pd.DataFrame(out, columns=["statistic", "p_value"])

    return solve


def adf_test(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit-root test with constant and trend; lag order is the cube root of n - 1.

    The regression is solved from sums of products per series. Values are centred and scaled by
    the series' own mean and deviation, which leaves the statistic unchanged.
    """
    whole = Window.partitionBy(*keys)
    scaled = series.select(
        *keys,
        "t",
        F.count("value").over(whole).alias("__n"),
        F.try_divide(
            F.col("value") - F.avg("value").over(whole), F.stddev_pop("value").over(whole)
        ).alias("value"),
    ).withColumn("__k", F.floor(F.cbrt(F.col("__n") - 1) + F.lit(1e-9)))
    longest = scaled.agg(F.max("__k")).first()[0] or 0
    diffed = scaled.withColumn("__level", lag_of("value", 1, keys)).withColumn(
        "__d", F.col("value") - F.col("__level")
    )
    lags = [
        F.when(F.col("__k") < k, F.lit(0.0)).otherwise(lag_of("__d", k, keys)).alias(f"__d{k}")
        for k in range(1, longest + 1)
    ]
    rows = diffed.select(*keys, "__k", "__n", "__d", "__level", "t", *lags)
    columns = [F.col("__d"), F.col("__level"), F.lit(1.0), F.col("t") / F.col("__n")]
    columns += [F.col(f"__d{k}") for k in range(1, longest + 1)]
    sums = gram(rows, [*keys, "__k"], columns)
    solved = sums.withColumn("__r", _adf_solver(4 + longest)("gram", "rows", "__k"))
    return solved.select(*keys, F.col("__k").alias("lag_order"), "__r.statistic", "__r.p_value")


def guerrero_lambda(
    series: DataFrame, keys: Sequence[str], low: float = -1.0, high: float = 2.0, step: float = 0.1, span: int = 2
) -> DataFrame:
    """Box-Cox exponent that makes sub-series spread most even (Guerrero 1993).

    Blocks of ``span`` periods, counted from the end, give a mean and a deviation each; every
    exponent of a fixed grid is scored by the variation of sd / mean^(1 - exponent).
    """
    whole = Window.partitionBy(*keys)
    blocks = (
        series.where(F.col("value").isNotNull())
        .withColumn("__b", F.floor((F.max("t").over(whole) - F.col("t")) / span))
        .groupBy(*keys, "__b")
        .agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"), F.count(F.lit(1)).alias("__c"))
        .where((F.col("__c") == span) & (F.col("__m") > 0))
    )
    steps = int(round((high - low) / step))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(i * step + low, 10)))
    ratios = blocks.withColumn("lambda", grid).withColumn(
        "__r", F.col("__s") / F.pow(F.col("__m"), 1 - F.col("lambda"))
    )
    scored = ratios.groupBy(*keys, "lambda").agg(
        F.try_divide(F.stddev_samp("__r"), F.avg("__r")).alias("cv")
    )
    return scored.groupBy(*keys).agg(
        F.min_by("lambda", F.struct("cv", "lambda")).alias("lambda"), F.min("cv").alias("cv")
    )


def box_cox(value: Column, exponent: Column) -> Column:
    return F.when(exponent == 0, F.ln(value)).otherwise((F.pow(value, exponent) - 1) / exponent)
