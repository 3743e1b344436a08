"""Missing-data profile, threshold filter and retention audit of a long panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.operators.relations import keep_keys


def missing_share(value: str = "value") -> Column:
    return F.avg(F.col(value).isNull().cast("double"))


def missing_rates(panel: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Share of missing cells by any set of panel keys."""
    return panel.groupBy(*by).agg(missing_share(value).alias("missing"))


def valid_keys(panel: DataFrame, key: str, limit: float, n_indicators: int) -> DataFrame:
    """Keys whose missing share stays within ``limit`` under every indicator."""
    rates = missing_rates(panel, [key, "indicator"])
    within = (F.col("missing") <= limit).cast("int")
    return (
        rates.groupBy(key)
        .agg(F.sum(within).alias("n_within"))
        .where(F.col("n_within") == n_indicators)
        .select(key)
    )


def threshold_filter(
    panel: DataFrame, n_indicators: int, year_limit: float = 0.55, entity_limit: float = 0.57
) -> DataFrame:
    """Keep years and entities that are complete enough in all indicators.

    Both rates are taken on the panel as given, not one after the other. The panel is read three
    times, so hand in a stored one (``materialize``) when it is expensive.
    """
    years = valid_keys(panel, "year", year_limit, n_indicators)
    entities = valid_keys(panel, "entity", entity_limit, n_indicators)
    return keep_keys(keep_keys(panel, years, "year"), entities, "entity")


def _counts(panel: DataFrame, name: str) -> DataFrame:
    return panel.groupBy("indicator").agg(F.count(F.lit(1)).alias(f"cells_{name}"), F.count("value").alias(f"non_null_{name}"))


def retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells and non-missing cells per indicator before and after a filter, with percentages."""
    both = _counts(before, "before").join(_counts(after, "after"), "indicator", "left")
    both = both.fillna(0, subset=["cells_after", "non_null_after"])
    return both.select(
        "*",
        F.round(F.try_divide(F.col("cells_after") * 100.0, F.col("cells_before")), 2).alias("cells_retained_pct"),
        F.round(F.try_divide(F.col("non_null_after") * 100.0, F.col("non_null_before")), 2).alias("non_null_retained_pct"),
    )
