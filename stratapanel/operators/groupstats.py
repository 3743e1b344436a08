"""Grouped descriptive statistics of panels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.functions.columns import geometric_mean, pearson, shifted_geometric_mean, weighted_mean
from stratapanel.operators.quantiles import exact_quantiles
from stratapanel.operators.relations import complete_cases, join_null_safe
from stratapanel.session import materialize


def group_means(df: DataFrame, by: Sequence[str], columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Means of several columns by any keys."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in columns])


def group_geometric_means(df: DataFrame, by: Sequence[str], value: str, out: str = "geometric_mean") -> DataFrame:
    return df.groupBy(*by).agg(geometric_mean(value).alias(out))


def group_shifted_geometric_means(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    return df.groupBy(*by).agg(shifted_geometric_mean(value).alias(out))


def feature_block(value: str, year: str = "year") -> dict[str, Column]:
    """Mean, deviation, extremes and yearly trend of one indicator, all in one aggregation."""
    column = F.col(value)
    return {
        f"{value}_mean": F.avg(column),
        f"{value}_sd": F.stddev_samp(column),
        f"{value}_min": F.min(column),
        f"{value}_max": F.max(column),
        f"{value}_slope": F.regr_slope(column, F.col(year).cast("double")),
    }


def entity_features(panel: DataFrame, columns: Sequence[str], key: str = "entity") -> DataFrame:
    """Feature block of every column per entity: one shuffle for all indicators."""
    blocks: dict[str, Column] = {}
    for column in columns:
        blocks.update(feature_block(column))
    return panel.groupBy(key).agg(*[c.alias(name) for name, c in blocks.items()])


def two_level_summary(df: DataFrame, entity: str, group: str, value: str) -> DataFrame:
    """Entity means, then mean, extremes and median of those by group."""
    means = df.groupBy(entity, group).agg(F.avg(value).alias("__m"))
    moments = means.groupBy(group).agg(
        F.avg("__m").alias("mean"), F.max("__m").alias("max"), F.min("__m").alias("min")
    )
    medians = exact_quantiles(means, "__m", [0.5], [group], ["median"])
    return join_null_safe(moments, medians, [group])


def distinct_members(df: DataFrame, by: Sequence[str], member: str, out: str = "n") -> DataFrame:
    """Distinct members by group, a missing member counting as one.

    Duplicates go first, so a group that holds most rows is counted in parts.
    """
    return df.select(*by, member).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def weighted_overall_mean(
    group_year: DataFrame, sizes: DataFrame, group: str, value: str, weight: str, out: str = "overall_mean"
) -> DataFrame:
    """Yearly mean over groups weighted by group size, attached to every group's row."""
    weighted = join_null_safe(group_year, sizes, [group])
    overall = weighted.groupBy("year").agg(weighted_mean(value, weight).alias(out))
    return group_year.join(overall, "year", "left")


def group_sums(df: DataFrame, by: str, value: str, out: str = "total") -> DataFrame:
    """Totals of the known groups, largest first."""
    known = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(by).agg(F.sum(value).alias(out)).orderBy(F.desc(out), by)


def correlations(df: DataFrame, by: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Several pairwise correlations by group in one aggregation."""
    return df.groupBy(*by).agg(*[pearson(x, y).alias(name) for name, (x, y) in pairs.items()])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations over rows complete in all columns, as ``(a, b, correlation)`` rows."""
    pairs = list(combinations(columns, 2))
    row = complete_cases(df.select(*columns)).agg(*[pearson(a, b).alias(f"{a}__{b}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("correlation")) for a, b in pairs]
    return row.select(F.inline(F.array(*entries)))


def frequencies(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width counts of each column between its extremes.

    The extremes come from one aggregation read as a scalar subquery; the counts of all columns
    come from one pass over the data.
    """
    extremes = df.agg(
        F.struct(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns]).alias("e")
    ).scalar()
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        F.col(c).cast("double").alias("x"),
                        extremes[c]["low"].cast("double").alias("low"),
                        extremes[c]["high"].cast("double").alias("high"),
                    )
                    for c in columns
                ]
            )
        )
    ).where(F.col("x").isNotNull())
    part = F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")) * bins
    number = F.least(F.floor(F.coalesce(part, F.lit(0.0))) + 1, F.lit(bins))
    return long.groupBy("feature", number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers (furthest values within 1.5 box lengths) and outliers by group.

    The boxes are written out, so that a short table of them is sent to the rows.
    """
    boxes = exact_quantiles(df, value, [0.25, 0.5, 0.75], [by], ["lower", "middle", "upper"])
    boxes = materialize(boxes, "boxes")
    rows = join_null_safe(df.select(by, value).where(F.col(value).isNotNull()), boxes, [by])
    reach = (F.col("upper") - F.col("lower")) * 1.5
    inside = F.col(value).between(F.col("lower") - reach, F.col("upper") + reach)
    return rows.groupBy(by).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.first("lower").alias("lower"),
        F.first("middle").alias("middle"),
        F.first("upper").alias("upper"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
    )
