"""One case per rule about missing values and edges."""

import math

import pytest
from pyspark.sql import functions as F

from stratapanel.functions import columns as C
from stratapanel.functions import distributions as D


def one(spark, values, *aggregates):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (None,)], "x double").select(C.nan_to_null("x").alias("x"))
    assert df.agg(F.avg("x"), F.count("x")).first() == (1.0, 1)


def test_finite(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (None,), (math.inf,)], "x double")
    assert df.where(C.is_finite("x")).count() == 1


def test_year_label(spark):
    df = spark.createDataFrame([("X1994",), ("note",)], "l string")
    assert [r[0] for r in df.select(C.year_of_label("l")).collect()] == [1994, None]


def test_year_start(spark):
    assert str(spark.range(1).select(C.year_start(F.lit(1994))).first()[0]) == "1994-01-01"


def test_geometric_means(spark):
    assert one(spark, [1.0, 4.0, None], C.geometric_mean("x"))[0] == pytest.approx(2.0)
    assert one(spark, [0.0, 4.0], C.geometric_mean("x"))[0] == 0.0
    assert one(spark, [-3.0, 4.0], C.geometric_mean("x"))[0] == pytest.approx(4.0)
    assert one(spark, [0.0, 3.0], C.shifted_geometric_mean("x"))[0] == pytest.approx(1.0)
    assert one(spark, [-1.0, 3.0], C.shifted_geometric_mean("x"))[0] == -1.0
    assert one(spark, [None], C.geometric_mean("x"))[0] is None


def test_sum_of_nothing_is_zero_and_weighted_mean_skips_missing(spark):
    assert one(spark, [None], C.sum_or_zero("x"))[0] == 0.0
    df = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (4.0, 2.0)], "x double, w double")
    assert df.agg(C.weighted_mean("x", "w")).first()[0] == pytest.approx(3.0)


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert df.agg(C.pearson("x", "y")).first()[0] is None


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 2.5, None)], "x double")
    got = [r[0] for r in df.select(C.right_closed_bin("x", [0, 1, 2], ["a", "b"])).collect()]
    assert got == ["a", "a", "b", "b", None, None]
    with pytest.raises(ValueError):
        C.right_closed_bin("x", [0, 1, 1], ["a", "b"])


def test_rescale_of_a_constant_is_one_half(spark):
    df = spark.createDataFrame([(2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(C.rescale_unit("x", F.lit(2.0), F.lit(2.0))).collect()] == [0.5, None]


@pytest.mark.parametrize(
    "value, expected",
    [
        (D.t_two_sided(2.7764451051977987, 4), 0.05),
        (D.t_two_sided(1.0, 1), 0.5),
        (D.t_two_sided(1.96, 1e7), 0.0499958181),
        (D.t_quantile(0.975, 6), 2.4469118511449692),
        (D.chi_square_upper(18.307038053275146, 10), 0.05),
        (D.chi_square_upper(3.841458820694124, 1), 0.05),
        (D.chi_square_upper(0.5, 4), math.exp(-0.25) * 1.25),
    ],
)
def test_distributions(value, expected):
    assert value == pytest.approx(expected, rel=1e-7)
