"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: Column | str) -> Column:
    """NaN counts as missing everywhere, so it becomes NULL on the way in."""
    value = as_column(value)
    return F.when(~F.isnan(value), value)


def is_finite(value: Column | str) -> Column:
    value = as_column(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def blank_to_null(value: Column | str) -> Column:
    value = as_column(value)
    return F.when(F.trim(value) != "", value)


def year_of_label(label: Column | str, prefix: str = "X") -> Column:
    """``X1994`` -> 1994; a label that is no year gives NULL."""
    return F.regexp_replace(as_column(label), f"^{prefix}", "").try_cast("int")


def year_start(year: Column | str) -> Column:
    return F.make_date(as_column(year).cast("int"), F.lit(1), F.lit(1))


def log10p1(value: Column | str) -> Column:
    return F.log10(as_column(value) + 1)


def geometric_mean(value: Column | str) -> Column:
    """exp(mean(log x)): one zero makes the result zero, negative values are left out."""
    value = as_column(value)
    logs = F.avg(F.ln(F.when(value > 0, value)))
    return F.when(F.max((value == 0).cast("int")) == 1, F.lit(0.0)).otherwise(F.exp(logs))


def shifted_geometric_mean(value: Column | str) -> Column:
    """exp(mean(log(x + 1))) - 1, with the zero rule moved to x = -1."""
    value = as_column(value)
    logs = F.avg(F.log1p(F.when(value > -1, value)))
    return F.when(F.max((value == -1).cast("int")) == 1, F.lit(-1.0)).otherwise(F.expm1(logs))


def sum_or_zero(value: Column | str) -> Column:
    return F.coalesce(F.sum(as_column(value)), F.lit(0.0))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean of ``value`` by ``weight``; pairs without a value drop out of both sums."""
    value, weight = as_column(value), as_column(weight)
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation over pairs with both values; NULL where one side does not vary."""
    x, y = as_column(x), as_column(y)
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def right_closed_bin(value: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Bins ``(a, b]`` with the lowest break included; outside the breaks the label is NULL."""
    value = as_column(value)
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per bin")
    if len(set(breaks)) != len(breaks):
        raise ValueError("breaks are not unique")
    chain = F.when(value < F.lit(float(breaks[0])), F.lit(None).cast("string"))
    for upper, label in zip(breaks[1:], labels):
        chain = chain.when(value <= F.lit(float(upper)), F.lit(label))
    return chain


def rescale_unit(value: Column | str, low: Column, high: Column) -> Column:
    """Min-max rescale to [0, 1]; a constant column gives 0.5."""
    value = as_column(value)
    return F.when(value.isNotNull() & (high == low), F.lit(0.5)).otherwise(
        F.try_divide(value - low, high - low)
    )


def hash_hex(key: Column | str, seed: int) -> Column:
    """Order of rows that depends on key and seed only, never on the partitioning."""
    return F.md5(F.concat(as_column(key).cast("string"), F.lit(f"#{seed}")))


def mean_absolute_error(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def root_mean_square_error(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def mean_absolute_percentage_error(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(F.try_divide(actual - predicted, actual))) * 100
