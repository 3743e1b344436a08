"""Exact interpolated quantiles of large groups.

``percentile`` keeps a group's distinct values in one aggregation buffer. Here only the buckets
that hold a wanted position are ordered, each in its own task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.operators.ranks import running_counts


def _position(p: float) -> Column:
    return (F.col("n_total") - 1) * F.lit(float(p))


def _holds(position: Column) -> Column:
    return (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), names: Sequence[str] | None = None
) -> DataFrame:
    """Linear interpolation between order statistics at ``(n - 1) p``; columns ``q0, q1, ...``."""
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    wanted = None
    for p in probs:
        for position in (F.floor(_position(p)), F.ceil(_position(p))):
            one = _holds(position)
            wanted = one if wanted is None else wanted | one
    ordered = running_counts(df, value, {"n": F.lit(1)}, by, keep=wanted)
    picks = []
    for i, p in enumerate(probs):
        low, high = F.floor(_position(p)), F.ceil(_position(p))
        picks += [
            F.max(F.when(_holds(low), F.col(value))).alias(f"__low{i}"),
            F.max(F.when(_holds(high), F.col(value))).alias(f"__high{i}"),
            F.max(_position(p) - low).alias(f"__part{i}"),
        ]
    stats = ordered.groupBy(*by).agg(*picks)
    return stats.select(
        *by,
        *[
            (F.col(f"__low{i}") + (F.col(f"__high{i}") - F.col(f"__low{i}")) * F.col(f"__part{i}")).alias(name)
            for i, name in enumerate(names)
        ],
    )
