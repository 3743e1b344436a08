import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import forecast, inference, series

def paths(spark, **values):
    rows = [(name, t + 1, float(v)) for name, path in values.items() for t, v in enumerate(path)]
    return spark.createDataFrame(rows, "s string, t int, value double")

def ar1(phi, n, seed):
    rng = np.random.default_rng(seed)
    x = [0.0]
    for _ in range(n):
        x.append(phi * x[-1] + rng.normal())
    return np.array(x[1:])

@pytest.fixture(scope="module")
def planted(spark):
    return {"stationary": 10 + ar1(0.7, 300, 1), "walk": np.cumsum(np.random.default_rng(2).normal(size=300)) + 50, "short": ar1(0.2, 22, 3)}

def test_acf_pacf_ljung_box(spark, planted):
    df = paths(spark, **planted)
    acf = {r.s: r.acf for r in series.autocorrelation(df, ["s"], 5).collect()}
    pacf = {r.s: r.pacf for r in series.partial_autocorrelation(df, ["s"], 3).collect()}
    for name, x in planted.items():
        c = x - x.mean()
        expected = [1.0] + [float((c[k:] * c[:-k]).sum() / (c**2).sum()) for k in range(1, 6)]
        assert np.allclose(acf[name], expected)
        r = expected
        system = np.array([[1, r[1], r[2]], [r[1], 1, r[1]], [r[2], r[1], 1]])
        assert pacf[name][2] == pytest.approx(np.linalg.solve(system, r[1:4])[2])
        n = len(x)
        q = n * (n + 2) * sum(r[k] ** 2 / (n - k) for k in range(1, 6))
        assert series.ljung_box(df, ["s"], 5).where(F.col("s") == name).first().q == pytest.approx(q)

def test_adf_statistic_matches_direct_regression(spark, planted):
    got = {r.s: r for r in series.adf_test(paths(spark, **planted), ["s"]).collect()}
    for name, x in planted.items():
        k, d = int((len(x) - 1) ** (1 / 3) + 1e-9), np.diff(x)
        rows = range(k, len(d))
        design = np.array([[x[i], 1.0, i + 1.0, *[d[i - j] for j in range(1, k + 1)]] for i in rows])
        y = d[k:]
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        rss = ((y - design @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(y) - design.shape[1]) * np.linalg.inv(design.T @ design)[0, 0])
        assert got[name].lag_order == k and got[name].statistic == pytest.approx(beta[0] / se, rel=1e-6)
    assert got["stationary"].p_value < 0.05 < got["walk"].p_value

def test_box_cox_lambda_near_zero_for_growth_with_proportional_noise(spark):
    rng = np.random.default_rng(4)
    x = np.exp(np.linspace(0, 4, 200)) * np.exp(rng.normal(scale=0.1, size=200))
    found = series.guerrero_lambda(paths(spark, g=x), ["s"]).first()
    assert abs(found["lambda"]) <= 0.3

def test_box_cox_transform(spark):
    df = spark.createDataFrame([(4.0, 0.0), (4.0, 0.5), (4.0, 1.0)], "x double, l double")
    got = [r[0] for r in df.select(series.box_cox(F.col("x"), F.col("l"))).collect()]
    assert got == pytest.approx([np.log(4), 2.0, 3.0])

def test_arima_recovers_planted_models(spark, planted):
    rows = forecast.arima_forecast(paths(spark, **planted), ["s"], h=3).orderBy("s", "t").collect()
    by = {name: [r for r in rows if r.s == name] for name in planted}
    assert by["stationary"][0].d == 0 and by["walk"][0].d == 1
    x = planted["stationary"]
    expected = x.mean() + 0.7 * (x[-1] - x.mean())
    assert by["stationary"][0].mean == pytest.approx(expected, abs=0.6)
    assert by["walk"][0].mean == pytest.approx(planted["walk"][-1], abs=1.5)
    for found in by.values():
        assert len(found) == 3 and all(r.low < r.mean < r.high for r in found)
        widths = [r.high - r.low for r in found]
        assert widths == sorted(widths)
    assert [r.t for r in by["short"]] == [23, 24, 25]
    # One-step band of a unit-variance process.
    assert by["stationary"][0].high - by["stationary"][0].low == pytest.approx(2 * 1.96, rel=0.15)

def test_arima_residuals_are_white_for_planted_model(spark, planted):
    df = paths(spark, stationary=planted["stationary"])
    residuals = forecast.arima_residuals(df, ["s"])
    row = residuals.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.max("terms").alias("k")).first()
    assert abs(row.m) < 0.1 and row.s == pytest.approx(1.0, abs=0.15) and row.k >= 1
    check = series.ljung_box(residuals, ["s", "terms"], 10, fitted=F.col("terms")).first()
    assert check.df == 10 - row.k and check.p_value > 0.01

def test_arima_of_a_straight_line_and_of_a_constant(spark):
    rows = forecast.arima_forecast(paths(spark, line=np.arange(40.0) * 2 + 1, flat=[5.0] * 30), ["s"], h=2).collect()
    got = {(r.s, r.t): r.mean for r in rows}
    assert got[("line", 41)] == pytest.approx(81, rel=1e-4) and got[("line", 42)] == pytest.approx(83, rel=1e-4)
    assert got[("flat", 31)] == pytest.approx(5)

def test_rolling_trend_and_metrics_skip_missing_targets(spark):
    x = [1.0, 3.0, 2.0, 5.0, 4.0, None]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(x)], "s string, t int, value double")
    rolled = {r.t: r.predicted for r in forecast.rolling_trend(df, ["s"]).collect()}
    slope, intercept = np.polyfit([1, 2, 3], x[:3], 1)
    assert rolled[1] is None and rolled[4] == pytest.approx(intercept + 4 * slope)
    metrics = forecast.rolling_metrics(forecast.rolling_naive(df, ["s"]), ["s"], 3, 5).first()
    assert metrics.n_origins == 2 and metrics.mae == pytest.approx((3 + 1) / 2)

def test_origins(spark):
    df = paths(spark, a=range(6))
    got = series.explode_origins(df, 3, 5).groupBy("s", "origin").count().collect()
    assert {(r.origin, r["count"]) for r in got} == {(3, 3), (4, 4), (5, 5)}

def yearly(name, values, start=1994):
    return [(name, dt.date(start + i, 1, 1), float(v)) for i, v in enumerate(values)]

def test_trend_is_a_line_in_days_and_bends_where_planted(spark):
    line = 40 - 0.8 * np.arange(28)
    bent = np.concatenate([np.arange(20.0), 20 - 3 * np.arange(8.0)])
    df = spark.createDataFrame(yearly("line", line) + yearly("bent", bent), "s string, ds date, value double")
    out = forecast.changepoint_trend(df, ["s"], h=5).toPandas()
    straight = out[out.s == "line"].sort_values("ds")
    assert len(straight) == 33 and straight.fitted.sum() == 28
    assert str(straight.ds.iloc[-1]) == "2026-01-01"
    days = np.array([(d - dt.date(1994, 1, 1)).days for d in straight.ds], float)
    fit = np.polyfit(days, straight.yhat, 1)
    assert np.abs(np.polyval(fit, days) - straight.yhat).max() < 0.05
    assert fit[0] == pytest.approx(-0.8 / 365.25, rel=0.02)
    assert ((straight.yhat_lower < straight.yhat) & (straight.yhat < straight.yhat_upper)).all()
    curved = out[out.s == "bent"].sort_values("ds")
    assert curved.n_changes.iloc[0] >= 1 and curved.yhat.iloc[10] < curved.yhat.iloc[19] > curved.yhat.iloc[27]

def test_future_and_split(spark):
    last = spark.createDataFrame([("a", dt.date(2021, 1, 1))], "s string, d date")
    assert [str(r.ds) for r in forecast.future_periods(last, "d", 3).collect()] == ["2022-01-01", "2023-01-01", "2024-01-01"]
    df = spark.createDataFrame([(2016,), (2017,), (2018,)], "period int")
    train, test = series.split_at(df, 2017)
    assert (train.count(), test.count()) == (2, 1)

def test_regression_line_and_band(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=50)
    y = 2 * x + 1 + rng.normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    line = inference.regression_line(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    rse = np.sqrt(((y - slope * x - intercept) ** 2).sum() / 48)
    assert (line.slope, line.intercept, line.residual_se) == (pytest.approx(slope), pytest.approx(intercept), pytest.approx(rse))
    band = inference.confidence_band(inference.regression_line(df, "x", "y"), [0.5]).first()
    half = 2.0106347546964454 * rse * np.sqrt(1 / 50 + (0.5 - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert band.high - band.fit == pytest.approx(half)

def gappy(spark, seed=5):
    """Monthly facts of two series, some months without any, one with a known value missing."""
    rng = np.random.default_rng(seed)
    rows, grids = [], {}
    for s, n, gaps in (("a", 60, {3, 4, 17, 40}), ("b", 48, {1, 30, 31, 32, 45})):
        x = np.cumsum(rng.normal(size=n)) + 10
        grids[s] = np.array([np.nan if k in gaps else v for k, v in enumerate(x)])
        for k, v in enumerate(grids[s]):
            if not np.isnan(v):
                day = f"{1995 + (k + 5) // 12}-{(k + 5) % 12 + 1:02d}-01"
                rows += [(s, day, float(v) / 2)] * 2
    facts = spark.createDataFrame(rows, "s string, day string, v double").select("s", F.col("day").cast("date").alias("day"), "v")
    return series.to_series(facts, ["s"], F.col("day"), F.sum("v")), grids

def test_periods_without_facts_are_missing_values(spark):
    df, grids = gappy(spark)
    for s, x in grids.items():
        rows = df.where(F.col("s") == s).orderBy("t").collect()
        assert [r.t for r in rows] == list(range(1, len(x) + 1))
        assert [(r.period.year * 12 + r.period.month) - (1995 * 12 + 6) for r in rows] == list(range(len(x)))
        assert np.array([np.nan if r.value is None else r.value for r in rows]) == pytest.approx(x, nan_ok=True)
    years = spark.createDataFrame([("a", 2001, 1.0), ("a", 2004, 2.0), ("b", 7, 3.0)], "s string, y int, v double")
    got = series.to_series(years, ["s"], F.col("y"), F.sum("v"), unit="number").orderBy("s", "t").collect()
    assert [(r.s, r.period, r.t, r.value) for r in got] == [("a", 2001, 1, 1.0), ("a", 2002, 2, None), ("a", 2003, 3, None), ("a", 2004, 4, 2.0), ("b", 7, 1, 3.0)]

def test_lags_are_periods(spark):
    df, grids = gappy(spark)
    acf = {r.s: r for r in series.autocorrelation(df, ["s"], 4).collect()}
    dropped = {r.s: r for r in series.autocorrelation(df.where("value is not null"), ["s"], 4).collect()}
    for s, x in grids.items():
        c = x - np.nanmean(x)
        n = np.isfinite(c).sum()
        for k in range(1, 5):
            pairs = c[k:] * c[:-k]
            expected = np.nansum(pairs) / (np.isfinite(pairs).sum() + k) / (np.nansum(c * c) / n)
            assert acf[s].acf[k] == pytest.approx(expected) and dropped[s].acf[k] == pytest.approx(expected)
        assert acf[s].n == n
    naive = forecast.rolling_naive(df, ["s"]).where("s = 'a'").orderBy("t").collect()
    assert naive[5].predicted is None and naive[4].predicted is None and naive[2].predicted == pytest.approx(grids["a"][1])
    x = grids["a"]
    adf = {r.s: r for r in series.adf_test(df, ["s"]).collect()}["a"]
    d = np.diff(x)
    rows = [[d[i], x[i], 1.0, i + 2, *[d[i - j] for j in range(1, adf.lag_order + 1)]] for i in range(adf.lag_order, len(d))]
    rows = np.array([r for r in rows if np.isfinite(r).all()])
    beta = np.linalg.lstsq(rows[:, 1:], rows[:, 0], rcond=None)[0]
    residual = rows[:, 0] - rows[:, 1:] @ beta
    spread = np.sqrt(residual @ residual / (len(rows) - rows.shape[1] + 1) * np.linalg.inv(rows[:, 1:].T @ rows[:, 1:])[0, 0])
    assert adf.statistic == pytest.approx(beta[0] / spread, rel=1e-6)
    assert forecast.arima_forecast(df, ["s"], h=3).where("mean is not null").count() == 6

def test_band_widens_with_the_horizon_and_covers(spark):
    rng = np.random.default_rng(8)
    inside, growth, rows, truth = [], [], [], {}
    for s in range(40):  # slopes change at every possible place of the past, and go on doing so after the last period
        change = np.zeros(124)
        change[np.round(np.linspace(0, 79, 26)).astype(int)[1:]] = rng.laplace(0, 0.3, 25)
        change[100:] = np.where(rng.random(24) < 25 / 80, rng.laplace(0, 0.3, 24), 0.0)
        x = 600 + np.cumsum(np.cumsum(change)) + rng.normal(0, 0.2, 124)
        truth[s] = x[100:]
        rows += [(s, f"{2000 + k // 12}-{k % 12 + 1:02d}-01", float(x[k])) for k in range(100)]
    df = spark.createDataFrame(rows, "s int, d string, value double").select("s", F.col("d").cast("date").alias("ds"), "value")
    first = forecast.changepoint_trend(df, ["s"], h=24).where("NOT fitted").orderBy("s", "ds").collect()
    again = forecast.changepoint_trend(df.repartition(5), ["s"], h=24).where("NOT fitted").orderBy("s", "ds").collect()
    assert [v for r in first for v in (r.yhat_lower, r.yhat_upper)] == pytest.approx([v for r in again for v in (r.yhat_lower, r.yhat_upper)])
    for s in range(40):
        mine = first[24 * s : 24 * s + 24]
        widths = [r.yhat_upper - r.yhat_lower for r in mine]
        growth.append(widths[-1] / widths[0])
        inside += [r.yhat_lower <= v <= r.yhat_upper for r, v in zip(mine, truth[s])]
    assert min(growth) > 0.9 and np.mean(growth) > 2

    assert 0.6 < np.mean(inside) <= 1.0
