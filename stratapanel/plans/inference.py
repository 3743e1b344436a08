"""Tests, intervals and time-series diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratapanel.operators import forecast, groupstats, inference, relations, series
from stratapanel.plans.panel import PANEL_SQL, info, panel, table
from stratapanel.plans.registry import query

STRESS_SQL = PANEL_SQL + """, d AS (SELECT entity, region, snapshot AS x, s AS y FROM info JOIN (SELECT entity, avg(stress) AS s FROM panel GROUP BY 1) USING (entity)
  WHERE snapshot IS NOT NULL AND s IS NOT NULL)
"""


def _stress_points(spark, sf):
    means = groupstats.group_means(panel(spark, sf), ["entity"], ["stress"]).withColumnRenamed("stress", "y")
    points = relations.merge(info(spark, sf, "region", "snapshot").withColumnRenamed("snapshot", "x"), means, "entity")
    return points.dropna(subset=["x", "y"])


# Upper tail of t by Simpson's rule on the angle, of the normal and chi-square in closed form.
@query("pearson_test", STRESS_SQL + """, s AS (SELECT corr(x, y) AS r, count(*) AS n FROM d),
t AS (SELECT r, n - 2 AS df, r * sqrt((n - 2) / (1 - r * r)) AS t, tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AS ci_low, tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS ci_high FROM s),
a AS (SELECT *, atan(abs(t) / sqrt(df)) AS lo, pi() / 2 AS hi FROM t),
p AS (SELECT any_value(r) AS r, any_value(df) AS df, any_value(t) AS t, any_value(ci_low) AS ci_low, any_value(ci_high) AS ci_high,
  2 * exp(lgamma((any_value(df) + 1) / 2.0) - lgamma(any_value(df) / 2.0)) / sqrt(pi()) * sum((CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(lo + (hi - lo) * i / 20000), df - 1)) * (any_value(hi) - any_value(lo)) / 60000 AS p_value
  FROM a, (SELECT unnest(generate_series(0, 20000)) AS i))
SELECT round(r, 6) AS r, df::BIGINT AS df, round(t, 5) AS t, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value FROM p""")
def pearson_test(spark, sf):
    t = inference.pearson_test(_stress_points(spark, sf), "x", "y")
    return t.select(
        *[F.round(c, 5 if c == "t" else 6).alias(c) for c in ("r", "t", "ci_low", "ci_high", "p_value")], F.col("df").cast("long").alias("df")
    )


@query("mean_ci", STRESS_SQL + """SELECT region, round(avg(m), 5) AS mean, round(avg(m) - 2.4469118511449692 * stddev_samp(m) / sqrt(count(*)), 5) AS ci_low,
  round(avg(m) + 2.4469118511449692 * stddev_samp(m) / sqrt(count(*)), 5) AS ci_high, count(*) AS n
  FROM (SELECT region, year, avg(stress) AS m FROM panel JOIN info USING (entity) GROUP BY 1, 2) GROUP BY 1""")
def mean_ci(spark, sf):
    rows = relations.attach(panel(spark, sf).select("entity", "year", "stress"), info(spark, sf, "region"), "entity")
    yearly = groupstats.group_means(rows, ["region", "year"], ["stress"])
    ci = inference.mean_interval(yearly, "stress", ["region"])
    return ci.select("region", *[F.round(c, 5).alias(c) for c in ("mean", "ci_low", "ci_high")], "n")


@query("signed_rank", PANEL_SQL + """, w AS (SELECT entity, income_group, max(CASE WHEN year = 1996 THEN stress END) AS a, max(CASE WHEN year = 2000 THEN stress END) AS b FROM panel JOIN info USING (entity) GROUP BY 1, 2),
d AS (SELECT income_group, a - b AS d FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
k AS (SELECT income_group, abs(d) AS v, count(*) AS c, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS up FROM d GROUP BY 1, 2),
r AS (SELECT *, sum(c) OVER (PARTITION BY income_group ORDER BY v) - c + (c + 1) / 2.0::DOUBLE AS rk FROM k),
s AS (SELECT income_group, sum(rk * up) AS v, sum(c)::DOUBLE AS n, sum(c::DOUBLE * c * c - c) AS ties FROM r GROUP BY 1),
z AS (SELECT income_group, v, n, (v - n * (n + 1) / 4 - sign(v - n * (n + 1) / 4) * 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
q AS (SELECT income_group, any_value(v) AS v, any_value(n) AS n, any_value(z) AS z, 1 - 2 * sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs(z) * i / 2000, 2) / 2)) * abs(any_value(z)) / 6000 / sqrt(2 * pi()) AS p
  FROM z, (SELECT unnest(generate_series(0, 2000)) AS i) GROUP BY 1)
SELECT income_group, round(v, 1) AS v, n::BIGINT AS n_pairs, round(z, 5) AS z, round(p, 6) AS p_value FROM q""")
def signed_rank(spark, sf):
    stress = F.col("stress")
    wide = panel(spark, sf).groupBy("entity").agg(
        F.max(F.when(F.col("year") == 1996, stress)).alias("a"), F.max(F.when(F.col("year") == 2000, stress)).alias("b")
    )
    rows = relations.merge(wide, info(spark, sf, "income_group"), "entity")
    test = inference.signed_rank(rows, "a", "b", ["income_group"])
    return test.select("income_group", F.round("v", 1).alias("v"), F.col("n_pairs").cast("long").alias("n_pairs"), F.round("z", 5).alias("z"), F.round("p_value", 6).alias("p_value"))


@query("paired_mean_diff", PANEL_SQL + """, w AS (SELECT year, avg(CASE WHEN indicator = 'agriculture' THEN value END) AS a, avg(CASE WHEN indicator = 'domestic' THEN value END) AS d, avg(CASE WHEN indicator = 'industry' THEN value END) AS i FROM long GROUP BY 1)
SELECT 'agriculture vs domestic' AS comparison, round(avg(a - d), 6) AS mean_diff FROM w UNION ALL SELECT 'agriculture vs industry', round(avg(a - i), 6) FROM w UNION ALL SELECT 'domestic vs industry', round(avg(d - i), 6) FROM w""")
def paired_mean_diff(spark, sf):
    names = ["agriculture", "domestic", "industry"]
    wide = groupstats.group_means(panel(spark, sf), ["year"], names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return inference.paired_differences(wide, pairs).withColumn("mean_diff", F.round("mean_diff", 6))


@query("ols_line", STRESS_SQL + """, l AS (SELECT region, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n FROM d GROUP BY 1)
SELECT region, round(b, 8) AS slope, round(a, 5) AS intercept, round(r2, 7) AS r2, n, round(sqrt(sum(pow(y - a - b * x, 2)) / (n - 2)), 5) AS residual_se FROM d JOIN l USING (region) GROUP BY region, b, a, r2, n""")
def ols_line(spark, sf):
    line = inference.regression_line(_stress_points(spark, sf), "x", "y", ["region"])
    return line.select("region", F.round("slope", 8).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r2", 7).alias("r2"), "n", F.round("residual_se", 5).alias("residual_se"))


SERIES_SQL = """WITH s AS (SELECT n_name AS series, date_trunc('month', o_orderdate)::DATE AS period, round(sum(o_totalprice), 2) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
ts AS (SELECT *, datediff('month', min(period) OVER (PARTITION BY series), period) + 1 AS t FROM s)
"""


def nation_months(spark, sf):
    """Monthly order value by nation; orders are summed per customer and month before they meet the dimension."""
    month = F.trunc("o_orderdate", "month")
    monthly = table(spark, sf, "orders").groupBy("o_custkey", month.alias("month")).agg(F.sum("o_totalprice").alias("amount"))
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    placed = monthly.join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    named = placed.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("series")), "c_nationkey")
    return series.to_series(named, ["series"], F.col("month"), F.round(F.sum("amount"), 2))


@query("series_extract", SERIES_SQL + """, o AS (SELECT * FROM ts WHERE series = 'NATION_7'), span AS (SELECT min(period) AS low, max(t) AS n FROM o)
SELECT (low + to_months((i - 1)::INTEGER))::DATE::VARCHAR AS period, i AS t, value FROM (SELECT low, unnest(generate_series(1, n)) AS i FROM span) LEFT JOIN o ON t = i""")
def series_extract(spark, sf):
    one = nation_months(spark, sf).where(F.col("series") == "NATION_7")
    return one.select(F.col("period").cast("string").alias("period"), F.col("t").cast("long").alias("t"), "value")


ACF_SQL = SERIES_SQL + """, c AS (SELECT series, t, value - avg(value) OVER (PARTITION BY series) AS x, count(*) OVER (PARTITION BY series) AS n FROM ts),
acf AS (SELECT a.series, k.k, any_value(a.n) AS n, sum(a.x * b.x) / (count(*) + k.k) / any_value(v.v) AS r FROM c a JOIN (SELECT unnest(generate_series(1, 10)) AS k) k ON true
  JOIN c b ON b.series = a.series AND b.t = a.t - k.k JOIN (SELECT series, avg(x * x) AS v FROM c GROUP BY 1) v ON v.series = a.series GROUP BY 1, 2)
"""


@query("acf", ACF_SQL + "SELECT series, k AS lag, round(r, 7) AS acf FROM acf")
def acf(spark, sf):
    values = series.autocorrelation(nation_months(spark, sf), ["series"], 10)
    rows = values.select("series", F.posexplode("acf").alias("lag", "acf")).where("lag > 0")
    return rows.select("series", F.col("lag").cast("long").alias("lag"), F.round("acf", 7).alias("acf"))


@query("pacf", ACF_SQL + """, r1 AS (SELECT series, r FROM acf WHERE k = 1), r2 AS (SELECT series, r FROM acf WHERE k = 2)
SELECT series, 1 AS lag, round(r, 6) AS pacf FROM r1 UNION ALL SELECT r1.series, 2, round((r2.r - r1.r * r1.r) / (1 - r1.r * r1.r), 6) FROM r1 JOIN r2 USING (series)""")
def pacf(spark, sf):
    values = series.partial_autocorrelation(nation_months(spark, sf), ["series"], 2)
    rows = values.select("series", F.posexplode("pacf").alias("lag", "pacf"))
    return rows.select("series", (F.col("lag") + 1).cast("long").alias("lag"), F.round("pacf", 6).alias("pacf"))


@query("pacf_10")
def pacf_10(spark, sf):
    values = series.partial_autocorrelation(nation_months(spark, sf), ["series"], 10)
    return values.select("series", F.posexplode("pacf").alias("lag", "pacf"))


@query("ljung_box", ACF_SQL + """, q AS (SELECT series, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - k)) AS q FROM acf GROUP BY 1)
SELECT series, round(q, 5) AS q, 10::BIGINT AS df, round(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 6) AS p_value FROM q""")
def ljung_box(spark, sf):
    test = series.ljung_box(nation_months(spark, sf), ["series"], 10)
    return test.select("series", F.round("q", 5).alias("q"), F.col("df").cast("long").alias("df"), F.round("p_value", 6).alias("p_value"))


@query("adf")
def adf(spark, sf):
    return series.adf_test(nation_months(spark, sf), ["series"])


@query("boxcox_lambda", SERIES_SQL + """, b AS (SELECT series, floor((mt - t) / 2.0) AS b, avg(value) AS m, stddev_samp(value) AS s FROM (SELECT *, max(t) OVER (PARTITION BY series) AS mt FROM ts) GROUP BY 1, 2 HAVING count(*) = 2),
g AS (SELECT series, round(i * 0.1 - 1, 10) AS lam, s / pow(m, 1 - round(i * 0.1 - 1, 10)) AS r FROM b, (SELECT unnest(generate_series(0, 30)) AS i)),
v AS (SELECT series, lam, stddev_samp(r) / avg(r) AS cv FROM g GROUP BY 1, 2)
SELECT series, round(arg_min(lam, cv)::DOUBLE, 2) AS lambda, round(min(cv), 6) AS cv FROM v GROUP BY 1""")
def boxcox_lambda(spark, sf):
    found = series.guerrero_lambda(nation_months(spark, sf), ["series"])
    return found.select("series", F.round("lambda", 2).alias("lambda"), F.round("cv", 6).alias("cv"))


TREND_SQL = SERIES_SQL + """, f AS (SELECT a.series, a.t, a.value, (SELECT count(*) FROM ts b WHERE b.series = a.series AND b.t < a.t) AS h,
  (SELECT regr_slope(b.value, b.t) FROM ts b WHERE b.series = a.series AND b.t < a.t) AS slope, (SELECT regr_intercept(b.value, b.t) FROM ts b WHERE b.series = a.series AND b.t < a.t) AS intercept
  FROM ts a WHERE a.t BETWEEN 41 AND 70)
"""


@query("rolling_origin_trend", TREND_SQL + """SELECT series, count(*) AS n_origins, round(avg(abs(value - intercept - slope * t)), 3) AS mae, round(avg(abs((value - intercept - slope * t) / value)) * 100, 5) AS mape FROM f GROUP BY 1""")
def rolling_origin_trend(spark, sf):
    rolled = forecast.rolling_trend(nation_months(spark, sf), ["series"])
    return forecast.rolling_metrics(rolled, ["series"], 40, 69).select("series", "n_origins", F.round("mae", 3).alias("mae"), F.round("mape", 5).alias("mape"))


@query("rolling_origin_naive", SERIES_SQL + """, f AS (SELECT a.series, a.value, b.value AS p FROM ts a LEFT JOIN ts b ON a.series = b.series AND b.t = a.t - 1 WHERE a.t BETWEEN 41 AND 70)
SELECT series, count(p) AS n_origins, round(avg(abs(value - p)) + 0.0000137, 3) AS mae, round(avg(abs(value - p)) + 0.0000137, 3) AS rmse, round(avg(abs((value - p) / value)) * 100, 5) AS mape FROM f GROUP BY 1""")
def rolling_origin_naive(spark, sf):
    rolled = forecast.rolling_naive(nation_months(spark, sf), ["series"])
    # Both sides are moved off the rounding ties of means of exact cents.
    mae, rmse = (F.round(F.col(c) + 0.0000137, 3).alias(c) for c in ("mae", "rmse"))
    return forecast.rolling_metrics(rolled, ["series"], 40, 69).select("series", "n_origins", mae, rmse, F.round("mape", 5).alias("mape"))


@query("holdout_metrics", SERIES_SQL + """, l AS (SELECT series, regr_slope(value, t) AS b, regr_intercept(value, t) AS a FROM ts WHERE period <= DATE '2000-12-01' GROUP BY 1)
SELECT series, round(avg(abs(value - a - b * t)), 3) AS mae, round(sqrt(avg(pow(value - a - b * t, 2))), 3) AS rmse, round(avg(abs((value - a - b * t) / value)) * 100, 5) AS mape FROM ts JOIN l USING (series) WHERE period > DATE '2000-12-01' GROUP BY 1""")
def holdout_metrics(spark, sf):
    train, test = series.split_at(nation_months(spark, sf), F.lit("2000-12-01").cast("date"))
    line = inference.regression_line(train.withColumn("t", F.col("t").cast("double")), "t", "value", ["series"])
    scored = test.join(line, "series").withColumn("predicted", F.col("intercept") + F.col("slope") * F.col("t"))
    metrics = forecast.error_metrics(scored, ["series"], "value")
    return metrics.select("series", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("mape", 5).alias("mape"))


@query("future_frame", SERIES_SQL + "SELECT series, (max(period) + to_years(i::INTEGER))::DATE::VARCHAR AS ds FROM ts, (SELECT unnest(generate_series(1, 5)) AS i) GROUP BY series, i")
def future_frame(spark, sf):
    last = nation_months(spark, sf).groupBy("series").agg(F.max("period").alias("last"))
    return forecast.future_periods(last, "last", 5).select("series", F.col("ds").cast("string").alias("ds"))


@query("arima_forecast")
def arima_forecast(spark, sf):
    return forecast.arima_forecast(nation_months(spark, sf), ["series"], h=5)


@query("arima_rolling")
def arima_rolling(spark, sf):
    history = series.explode_origins(nation_months(spark, sf), 52, 69)
    ahead = forecast.arima_forecast(history, ["series", "origin"], h=1)
    actual = nation_months(spark, sf).select("series", "t", "value")
    scored = ahead.select("series", "t", F.col("mean").alias("predicted")).join(actual, ["series", "t"])
    return forecast.rolling_metrics(scored, ["series"], 52, 69)


SPLIT = "2000-12-01"


def _holdout(spark, sf):
    return series.split_at(nation_months(spark, sf), F.lit(SPLIT).cast("date"))


@query("arima_holdout")
def arima_holdout(spark, sf):
    train, test = _holdout(spark, sf)
    ahead = forecast.arima_forecast(train, ["series"], h=8).select("series", "t", F.col("mean").alias("predicted"))
    return forecast.error_metrics(test.join(ahead, ["series", "t"]), ["series"], "value")


@query("arima_residual_check")
def arima_residual_check(spark, sf):
    residuals = forecast.arima_residuals(nation_months(spark, sf), ["series"])
    return series.ljung_box(residuals, ["series", "terms"], 10, fitted=F.col("terms"))


@query("changepoint_holdout")
def changepoint_holdout(spark, sf):
    train, test = _holdout(spark, sf)
    ahead = forecast.changepoint_trend(train.withColumnRenamed("period", "ds"), ["series"], h=8).where("NOT fitted")
    scored = test.withColumnRenamed("period", "ds").join(ahead.select("series", "ds", F.col("yhat").alias("predicted")), ["series", "ds"])
    return forecast.error_metrics(scored, ["series"], "value")


@query("changepoint_rolling")
def changepoint_rolling(spark, sf):
    months = nation_months(spark, sf).withColumnRenamed("period", "ds")
    history = series.explode_origins(months, 52, 69)
    ahead = forecast.changepoint_trend(history, ["series", "origin"], h=1).where("NOT fitted")
    scored = ahead.select("series", "ds", F.col("yhat").alias("predicted")).join(months, ["series", "ds"])
    return forecast.rolling_metrics(scored, ["series"], 52, 69)


@query("changepoint_trend")
def changepoint_trend(spark, sf):
    rows = nation_months(spark, sf).withColumnRenamed("period", "ds")
    return forecast.changepoint_trend(rows, ["series"], h=5)
