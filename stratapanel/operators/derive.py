"""Derived indicators, growth labels and quantile groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.functions.columns import right_closed_bin
from stratapanel.operators.quantiles import exact_quantiles

# Labels of the population groups, the income groups and the growth classes.
POPULATION_GROUPS = ["Very Low", "Low", "Average", "High", "Very High"]
GDP_GROUPS = ["Low", "Lower-Mid", "Mid", "Upper-Mid", "High"]
SLOW, RAPID = "Slow_growth", "Rapid_growth"


def product(a: Column, b: Column) -> Column:
    """Productivity x withdrawals, or per-capita value x population."""
    return a * b


def ratio_percent(a: Column, b: Column) -> Column:
    """Withdrawals / stress x 100; a zero denominator gives NULL."""
    return F.try_divide(a, b) * 100


def combine(left: DataFrame, right: DataFrame, how, keys: Sequence[str] = ("entity", "year")) -> DataFrame:
    """Derive one indicator from two long ones, matched on their keys and not on row position."""
    a = left.select(*keys, F.col("value").alias("__a"))
    b = right.select(*keys, F.col("value").alias("__b"))
    return a.join(b, list(keys)).select(*keys, how(F.col("__a"), F.col("__b")).alias("value"))


def growth_label(
    df: DataFrame, value: str, first: int, last: int, limit: float = 30.0, key: str = "entity"
) -> DataFrame:
    """Label entities by the percentage growth between two years; missing growth counts as rapid.

    Every entity of ``df`` is labelled, also one without rows in either year.
    """
    ends = df.groupBy(key).agg(
        F.max(F.when(F.col("year") == first, F.col(value))).alias("__first"),
        F.max(F.when(F.col("year") == last, F.col(value))).alias("__last"),
    )
    rate = F.try_divide(F.col("__last") - F.col("__first"), F.col("__first")) * 100
    return ends.select(
        key,
        rate.alias("growth_rate"),
        F.when(rate < limit, F.lit(SLOW)).otherwise(F.lit(RAPID)).alias("label"),
    )


def quantile_breaks(df: DataFrame, value: str, groups: int = 5) -> list[float]:
    """Cut points of equal-share groups: ``groups + 1`` numbers, whatever the size of ``df``."""
    probs = [i / groups for i in range(groups + 1)]
    row = exact_quantiles(df, value, probs).first()
    return [row[f"q{i}"] for i in range(groups + 1)]


def bin_by_breaks(df: DataFrame, value: str, breaks: Sequence[float], labels: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, right_closed_bin(value, breaks, labels))
