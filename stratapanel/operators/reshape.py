"""Wide and long forms of a panel."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stratapanel.functions.columns import nan_to_null, year_of_label

YEAR_LABEL = r"^X\d{4}$"


def year_columns(df: DataFrame, first: int | None = None, last: int | None = None) -> list[str]:
    """Names of the year columns, optionally limited to a range of years."""
    names = [name for name in df.columns if re.match(YEAR_LABEL, name)]
    return [
        name
        for name in names
        if (first is None or int(name[1:]) >= first) and (last is None or int(name[1:]) <= last)
    ]


def columns_like(
    df: DataFrame, prefix: str = "", suffixes: Sequence[str] = ("",), keep: Sequence[str] = ()
) -> DataFrame:
    """Select ``keep`` and every column with the prefix and one of the suffixes."""
    chosen = [c for c in df.columns if c not in keep and c.startswith(prefix) and c.endswith(tuple(suffixes))]
    return df.select(*keep, *chosen)


def column_range(df: DataFrame, first: str, last: str, keep: Sequence[str] = ()) -> DataFrame:
    """Select the columns from ``first`` to ``last`` as they stand in the frame."""
    names = df.columns
    return df.select(*keep, *names[names.index(first) : names.index(last) + 1])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | None = None,
    names_to: str = "indicator",
    values_to: str = "value",
) -> DataFrame:
    """Wide to long. Cells without a value stay; choose ``values`` here, since a later filter on
    the name column is not pushed below the unpivot."""
    values = list(values) if values is not None else [c for c in df.columns if c not in ids]
    doubles = [nan_to_null(F.col(f"`{name}`").cast("double")).alias(name) for name in values]
    return df.select(*ids, *doubles).unpivot(list(ids), values, names_to, values_to)


def years_to_long(
    df: DataFrame,
    ids: Sequence[str],
    first: int | None = None,
    last: int | None = None,
    value: str = "value",
) -> DataFrame:
    """One row per entity and year from a frame with one column per year."""
    long = to_long(df, ids, year_columns(df, first, last), "year_label", value)
    return long.select(*ids, year_of_label("year_label").alias("year"), value)


def to_wide(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence, values_from: str
) -> DataFrame:
    """Long to wide with the names given, so no extra job looks for them.

    One conditional aggregate a name: a pivot would group by key and name first and shuffle twice.
    """
    value, given = F.col(values_from), F.col(names_from)
    return df.groupBy(*keys).agg(*[F.first(F.when(given == F.lit(name), value), ignorenulls=True).alias(str(name)) for name in names])


def tagged_union(frames: dict[str, DataFrame], tag: str = "category") -> DataFrame:
    """Stack frames of equal schema and mark the rows with the frame's name."""
    parts = [frame.withColumn(tag, F.lit(name)) for name, frame in frames.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def relabel_snapshot(df: DataFrame, year: int, as_year: int, year_col: str = "year") -> DataFrame:
    """Keep one year of a panel and file it under another one."""
    return df.filter(F.col(year_col) == year).withColumn(year_col, F.lit(as_year).cast("int"))


def spread_snapshot(df: DataFrame, first: int, last: int, year_col: str = "year") -> DataFrame:
    """Repeat one observation per entity over a range of years; a map-side expansion, no join."""
    return df.withColumn(year_col, F.explode(F.sequence(F.lit(first), F.lit(last))))
