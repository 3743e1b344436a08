"""Imputation by category and by group, and presence labels.

The group means are aggregated first (partial sums before the shuffle) and joined back, instead of
a window over the group: a window would bring a whole group into one task. The means are written
out, so that the planner knows their size and sends a small table to the rows, which then stay
where they are; a large one is joined by shuffle with skewed groups split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stratapanel.operators.relations import join_null_safe
from stratapanel.session import materialize


def impute_by_category(df: DataFrame, value: str, category: str, out: str | None = None) -> DataFrame:
    """Prediction of a regression on one category, that is the category's mean.

    A missing category has no prediction: plain equality leaves such rows as they are.
    """
    known = df.where(F.col(category).isNotNull())
    means = materialize(known.groupBy(category).agg(F.avg(value).alias("__mean")), "means")
    return (
        df.join(means, category, "left")
        .withColumn(out or value, F.coalesce(F.col(value), F.col("__mean")))
        .drop("__mean")
    )


def impute_by_group(df: DataFrame, value: str, by: Sequence[str], out: str | None = None) -> DataFrame:
    """Fill missing values with the mean of their group; rows with a missing key form a group."""
    means = materialize(df.groupBy(*by).agg(F.avg(value).alias("__mean")), "means")
    return (
        join_null_safe(df, means, by)
        .withColumn(out or value, F.coalesce(F.col(value), F.col("__mean")))
        .drop("__mean")
    )


def presence_label(panel: DataFrame, key: str = "entity", value: str = "value") -> DataFrame:
    """1 for an entity with at least one observed period, else 0."""
    return panel.groupBy(key).agg(F.max(F.col(value).isNotNull().cast("int")).alias("has_data"))
