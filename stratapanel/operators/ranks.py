"""Ranks and running counts over a whole table without a one-task window.

Rows are first aggregated to distinct values (map-side), then put into value-ordered buckets whose
cut points are a constant-size list. Running sums are taken inside each bucket and shifted by the
totals of the buckets below, a table of at most ``MAX_BUCKETS`` rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.operators.relations import join_null_safe

MAX_BUCKETS = 1024
ROWS_PER_BUCKET = 100_000
STRETCH = 64


def value_cuts(df: DataFrame, value: str) -> list[float]:
    """About evenly filled cut points, more of them for more rows; only this short list reaches
    the driver.

    They are literals of the later plan, so every branch of it sees the same buckets.
    """
    # One SQL string is parsed much faster than a thousand literal columns are built.
    probs = ", ".join(f"{i / MAX_BUCKETS!r}D" for i in range(1, MAX_BUCKETS))
    sketch = F.expr(f"percentile_approx(cast(`{value}` as double), array({probs}), {10 * MAX_BUCKETS})")
    cuts, n = df.agg(sketch, F.count(value)).first()
    # At least one cut: with a constant bucket the join on it would have no key left.
    step = min(max(1, MAX_BUCKETS * ROWS_PER_BUCKET // max(n, 1)), MAX_BUCKETS // 2)
    return sorted(set((cuts or [])[step - 1 :: step]))


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below the value: a balanced tree of comparisons, and for long lists a
    tree over every 64th cut followed by a look into one short stretch of them."""

    def tree(points: Sequence[float], low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(points[middle]), tree(points, low, middle)).otherwise(tree(points, middle + 1, high))

    if len(cuts) <= STRETCH:
        return tree(cuts, 0, len(cuts))
    coarse = cuts[STRETCH - 1 :: STRETCH]
    stretches = [cuts[i : i + STRETCH] for i in range(0, len(cuts), STRETCH)]
    stretches += [[]] * (len(coarse) + 1 - len(stretches))
    table = F.array(*[F.array(*[F.lit(float(c)) for c in part]).cast("array<double>") for part in stretches])
    block = tree(coarse, 0, len(coarse))
    inside = F.size(F.filter(table[block], lambda cut: cut < value))
    return block * STRETCH + inside


def running_counts(
    df: DataFrame, value: str, weights: dict[str, Column], by: Sequence[str] = (), keep=None
) -> DataFrame:
    """Per distinct value: each weight summed, its total strictly below (``<w>_below``) and the
    group total (``<w>_total``).

    ``keep(offsets)`` may filter the buckets that matter (for quantiles) before their rows are
    ordered; it sees the bucket's weights with the same ``_below`` and ``_total`` columns.
    """
    cuts = value_cuts(df, value)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(*[F.sum(w).alias(name) for name, w in weights.items()])
        .withColumn("__bucket", bucket_of(F.col(value), cuts))
    )
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy(*by, "__bucket").agg(*[F.sum(name).alias(name) for name in weights])
    offsets = offsets.select(
        *by,
        "__bucket",
        *weights,
        *[F.coalesce(F.sum(name).over(below), F.lit(0)).alias(f"{name}_below") for name in weights],
        *[F.sum(name).over(group).alias(f"{name}_total") for name in weights],
    )
    if keep is not None:
        offsets = offsets.where(keep)
    offsets = offsets.drop(*weights)
    keys = [*by, "__bucket"]
    rows = join_null_safe(counts, offsets, keys, "inner")
    local = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        *by,
        value,
        *weights,
        *[
            (F.col(f"{name}_below") + F.coalesce(F.sum(name).over(local), F.lit(0))).alias(f"{name}_below")
            for name in weights
        ],
        *[f"{name}_total" for name in weights],
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their count ``n`` and the mean rank of the tied rows."""
    ranked = running_counts(df, value, {"n": F.lit(1)}, by)
    return ranked.select(*by, value, "n", (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))


def position_by_hash(df: DataFrame, hash_col: str, by: Sequence[str] = (), width: int = 3) -> DataFrame:
    """0-based ``position`` of each row in hex-hash order within its group.

    Hash prefixes are the buckets: they are even by construction, so no cut points are needed and
    a class that holds most rows is still ordered in ``16 ** width`` parts.
    """
    bucketed = df.withColumn("__bucket", F.substring(hash_col, 1, width))
    totals = bucketed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__bucket", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below"))
    local = Window.partitionBy(*by, "__bucket").orderBy(hash_col)
    return (
        join_null_safe(bucketed, offsets, [*by, "__bucket"], "inner")
        .withColumn("position", F.col("__below") + F.row_number().over(local) - 1)
        .drop("__bucket", "__below")
    )
