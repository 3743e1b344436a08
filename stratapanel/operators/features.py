"""Standardised features and feature matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.functions.columns import rescale_unit
from stratapanel.operators.groupstats import entity_features


def _one_row(df: DataFrame, stats: dict[str, Column]) -> Column:
    """One-row statistics as a scalar subquery: no cross join, nothing on the driver."""
    return df.agg(F.struct(*[c.alias(name) for name, c in stats.items()]).alias("s")).scalar()


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the mean and divide by the sample deviation; a constant column becomes NULL."""
    stats = {f"{c}_m": F.avg(c) for c in columns} | {f"{c}_s": F.stddev_samp(c) for c in columns}
    s = _one_row(df, stats)
    scaled = {c: F.try_divide(F.col(c) - s[f"{c}_m"], s[f"{c}_s"]) for c in columns}
    return df.withColumns(scaled)


def rescale(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Rescale columns to [0, 1] by the extremes of ``fitted_on`` (the training part), or of ``df``."""
    source = fitted_on if fitted_on is not None else df
    s = _one_row(source, {f"{c}_lo": F.min(c) for c in columns} | {f"{c}_hi": F.max(c) for c in columns})
    return df.withColumns({c: rescale_unit(c, s[f"{c}_lo"], s[f"{c}_hi"]) for c in columns})


def standardise_by(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame) -> DataFrame:
    """Centre and scale by the moments of the training part only."""
    stats = {f"{c}_m": F.avg(c) for c in columns} | {f"{c}_s": F.stddev_samp(c) for c in columns}
    s = _one_row(fitted_on, stats)
    return df.withColumns({c: F.try_divide(F.col(c) - s[f"{c}_m"], s[f"{c}_s"]) for c in columns})


def feature_matrix(panel: DataFrame, columns: Sequence[str], labels: DataFrame, key: str = "entity") -> DataFrame:
    """Mean, deviation, extremes and slope of each indicator with the label; complete rows only."""
    block = entity_features(panel, columns, key)
    return block.join(labels.select(key, "label"), key, "left").dropna()


def assembled(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)
