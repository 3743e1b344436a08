"""Joins, key sets and row-set operations.

No join here carries a broadcast hint: dimensions grow with the number of entities, so the choice
is left to the planner, which knows file sizes, and to adaptive execution, which knows run-time
sizes and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def attach(df: DataFrame, dim: DataFrame, on: Sequence[str] | str, columns: Sequence[str] | None = None,
           fill: str | None = None) -> DataFrame:
    """Left join to a dimension; ``fill`` replaces missing attributes."""
    keys = [on] if isinstance(on, str) else list(on)
    columns = list(columns) if columns is not None else [c for c in dim.columns if c not in keys]
    joined = df.join(dim.select(*keys, *columns), keys, "left")
    return joined.fillna(fill, subset=columns) if fill is not None else joined


def attach_as(df: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left join of differently named keys; every row of the left (the map base) is kept."""
    return df.join(right.withColumnRenamed(right_key, left_key), left_key, "left")


def merge(left: DataFrame, right: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return left.join(right, on, "inner")


def fold_left(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left joins folded over a list of frames on the same keys."""
    return reduce(lambda left, right: left.join(right, list(on), "left"), frames)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join where missing keys match each other, as group summaries joined back need it."""
    marked = right.withColumnsRenamed({key: f"__{key}" for key in keys})
    condition = reduce(lambda a, b: a & b, [left[key].eqNullSafe(marked[f"__{key}"]) for key in keys])
    return left.join(marked, condition, how).drop(*[f"__{key}" for key in keys])


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on), on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on), on, "left_anti")


def keys_in_all(df: DataFrame, key: str, tag: str, n_tags: int) -> DataFrame:
    """Keys found under every tag: one pass instead of a chain of intersections."""
    pairs = df.select(key, tag).where(F.col(tag).isNotNull()).distinct()
    return pairs.groupBy(key).count().where(F.col("count") == n_tags).select(key)


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN."""
    return df.dropna(subset=list(subset) if subset else None)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
