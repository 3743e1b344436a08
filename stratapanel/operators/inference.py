"""Tests, intervals and regression lines from sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stratapanel.functions.columns import pearson
from stratapanel.functions.distributions import normal_two_sided_p, t_critical, t_two_sided_p
from stratapanel.operators.ranks import running_counts

# Fixed value: upper 2.5 % point of the standard normal.
Z_975 = 1.959963984540054


def pearson_test(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, t statistic, degrees of freedom, p-value and Fisher interval (95 %)."""
    base = df.groupBy(*by).agg(pearson(x, y).alias("r"), F.regr_count(y, x).alias("n"))
    r = F.col("r")
    stats = base.select(
        *by,
        "r",
        (F.col("n") - 2).alias("df"),
        (r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r))).alias("t"),
        F.when(F.col("n") > 3, F.tanh(F.atanh(r) - F.lit(Z_975) / F.sqrt(F.col("n") - 3))).alias("ci_low"),
        F.when(F.col("n") > 3, F.tanh(F.atanh(r) + F.lit(Z_975) / F.sqrt(F.col("n") - 3))).alias("ci_high"),
    )
    return stats.withColumn("p_value", t_two_sided_p(F.col("t"), F.col("df").cast("double")))


def mean_interval(df: DataFrame, value: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Mean with its t interval."""
    base = df.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )
    critical = t_critical(F.lit((1 + level) / 2), (F.col("n") - 1).cast("double"))
    half = critical * F.col("sd") / F.sqrt("n")
    return base.withColumn("__half", half).select(
        *by,
        "mean",
        (F.col("mean") - F.col("__half")).alias("ci_low"),
        (F.col("mean") + F.col("__half")).alias("ci_high"),
        "n",
    )


def signed_rank(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Paired signed-rank test: normal approximation with tie and continuity corrections.

    Zero differences drop out. Rows are reduced to distinct absolute differences before they are
    ranked, and the ranking needs no single-task window.
    """
    diff = F.col(first) - F.col(second)
    rows = df.select(*by, diff.alias("__d")).where(F.col("__d").isNotNull() & (F.col("__d") != 0))
    rows = rows.select(*by, F.abs("__d").alias("__a"), (F.col("__d") > 0).cast("long").alias("__up"))
    counts = running_counts(rows, "__a", {"n": F.lit(1), "ups": F.col("__up")}, by)
    n = F.col("n").cast("double")
    rank = F.col("n_below") + (n + 1) / 2
    sums = counts.groupBy(*by).agg(
        F.sum(rank * F.col("ups")).alias("v"),
        F.sum("n").alias("n_pairs"),
        F.sum(n * n * n - n).alias("__ties"),
    )
    m = F.col("n_pairs").cast("double")
    shift = F.col("v") - m * (m + 1) / 4
    sigma = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("__ties") / 48)
    return (
        sums.withColumn("z", F.try_divide(shift - F.signum(shift) * 0.5, sigma))
        .withColumn("p_value", normal_two_sided_p("z"))
        .drop("__ties")
    )


def paired_differences(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean difference of each pair of columns, as ``(comparison, mean_diff)`` rows."""
    row = wide.agg(*[F.avg(F.col(a) - F.col(b)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.col(f"d{i}").alias("mean_diff"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*entries)))


def regression_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line with residual error and what a confidence band needs."""
    base = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
        F.regr_avgx(y, x).alias("mean_x"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("__syy"),
        F.regr_sxy(y, x).alias("__sxy"),
    )
    rss = F.greatest(F.col("__syy") - F.col("slope") * F.col("__sxy"), F.lit(0.0))
    residual = F.when(F.col("n") > 2, F.sqrt(F.try_divide(rss, F.col("n") - 2)))
    return base.withColumn("residual_se", residual).drop("__syy", "__sxy")


def confidence_band(line: DataFrame, at: Sequence[float]) -> DataFrame:
    """95 % band of a fitted line over a short list of x values."""
    points = line.withColumn("x", F.explode(F.array(*[F.lit(float(v)) for v in at])))
    spread = F.sqrt(1 / F.col("n") + F.pow(F.col("x") - F.col("mean_x"), 2) / F.col("sxx"))
    points = points.withColumn(
        "__half", t_critical(F.lit(0.975), (F.col("n") - 2).cast("double")) * F.col("residual_se") * spread
    )
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    return points.select(
        "x", fit.alias("fit"), (fit - F.col("__half")).alias("low"), (fit + F.col("__half")).alias("high")
    )
