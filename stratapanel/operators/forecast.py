"""Forecasters for many series and origins in parallel.

Orders and coefficients come from sums of products per series, so the rows stay in Spark; only one
short matrix per series reaches Python. A rolling evaluation is the same job with the origin as
part of the key.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratapanel.functions.columns import (
    mean_absolute_error,
    mean_absolute_percentage_error,
    root_mean_square_error,
)
from stratapanel.operators.series import by_time, full_matrix, gram, lag_of
from stratapanel.session import materialize

# 5 % point of the level-stationarity test, and normal points of the bands.
KPSS_5PCT = 0.463
Z_975, Z_900 = 1.959963984540054, 1.2815515655446004


def error_metrics(df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    a, p = F.col(actual), F.col(predicted)
    return df.groupBy(*by).agg(
        mean_absolute_error(a, p).alias("mae"),
        root_mean_square_error(a, p).alias("rmse"),
        mean_absolute_percentage_error(a, p).alias("mape"),
    )


def future_periods(last: DataFrame, column: str, n: int, every: str = "1 year") -> DataFrame:
    """The ``n`` periods after a date, as rows."""
    step = F.expr(f"interval {every}")
    days = F.sequence(F.col(column) + step, F.col(column) + step * n, step)
    return last.withColumn("ds", F.explode(F.transform(days, lambda day: day.cast("date"))))


def rolling_trend(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-step forecast of every period by the line through all earlier ones."""
    past = by_time(keys).rowsBetween(Window.unboundedPreceding, -1)
    x, y = F.col("t").cast("double"), F.col("value")
    slope, intercept = F.regr_slope(y, x).over(past), F.regr_intercept(y, x).over(past)
    return series.withColumn("predicted", intercept + slope * x)


def rolling_naive(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-step forecast of every period by the one before it."""
    return series.withColumn("predicted", lag_of("value", 1, keys))


def rolling_metrics(forecasts: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Mean of the per-origin errors over targets ``first + 1 .. last + 1`` that were observed."""
    targets = forecasts.where(F.col("t").between(first + 1, last + 1) & F.col("value").isNotNull())
    per_origin = error_metrics(targets, [*keys, "t"], "value", "predicted")
    return per_origin.groupBy(*keys).agg(
        F.count("mae").alias("n_origins"),
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.avg("mape").alias("mape"),
    )


def _kpss(series: DataFrame, keys: Sequence[str], column: str, longest: int) -> DataFrame:
    """Level-stationarity statistic per series, Bartlett weights over 4 (n / 100)^(1/4) lags."""
    rows = series.where(F.col(column).isNotNull())
    whole = Window.partitionBy(*keys)
    centred = rows.select(
        *keys, "t", (F.col(column) - F.avg(column).over(whole)).alias("__e"), F.count(column).over(whole).alias("__n")
    )
    centred = centred.withColumn("__l", F.floor(4 * F.pow(F.col("__n") / 100, F.lit(0.25))))
    order = by_time(keys)
    lagged = centred.select(
        *keys,
        "__n",
        "__l",
        "__e",
        F.sum("__e").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__s"),
        *[
            F.when(F.col("__l") >= k, (1 - k / (F.col("__l") + 1)) * lag_of("__e", k, keys)).alias(f"__w{k}")
            for k in range(1, longest + 1)
        ],
    )
    weighted = sum([F.coalesce(F.col(f"__w{k}"), F.lit(0.0)) for k in range(1, longest + 1)], F.lit(0.0))
    long_run = F.sum(F.col("__e") * (F.col("__e") + 2 * weighted))
    n = F.first("__n")
    return lagged.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("__s") * F.col("__s")) / (n * n), long_run / n).alias("kpss")
    )


def difference_order(series: DataFrame, keys: Sequence[str], most: int = 2) -> DataFrame:
    """Smallest number of differences (up to ``most``) after which a series looks stationary."""
    current, column = series, "value"
    most_periods = series.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    longest = int(4 * (most_periods / 100) ** 0.25)
    choices = series.select(*keys).distinct()
    flags = []
    for d in range(most):
        stats = _kpss(current, keys, column, longest).select(*keys, (F.col("kpss") <= KPSS_5PCT).alias(f"__ok{d}"))
        choices = choices.join(stats, list(keys), "left")
        flags.append(F.when(F.coalesce(F.col(f"__ok{d}"), F.lit(True)), F.lit(d)))
        current = current.withColumn("__diff", F.col(column) - lag_of(column, 1, keys)).drop(
            *([column] if d else [])
        ).withColumnRenamed("__diff", f"__d{d + 1}")
        column = f"__d{d + 1}"
    return choices.select(*keys, F.coalesce(*flags, F.lit(most)).alias("d"))


def _long_ar_solver(order: int):
    @F.pandas_udf("array<double>")
    def solve(triangles: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for triangle, n in zip(triangles, rows):
            full = full_matrix(triangle, order + 2)
            usable = min(order, max(int(n) // 4, 0))
            keep = [1, *range(2, 2 + usable)]
            beta = np.linalg.lstsq(full[np.ix_(keep, keep)], full[keep, 0], rcond=None)[0]
            out.append([*map(float, beta), *[0.0] * (order - usable)])
        return pd.Series(out)

    return solve


def _arma_solver(most_ar: int, most_ma: int):
    size = 2 + most_ar + most_ma

    @F.pandas_udf("p int, q int, constant double, ar array<double>, ma array<double>, sigma2 double, aicc double")
    def solve(triangles: pd.Series, rows: pd.Series, d: pd.Series) -> pd.DataFrame:
        out = []
        for triangle, n, differences in zip(triangles, rows, d):
            full, best = full_matrix(triangle, size), None
            for p in range(most_ar + 1):
                for q in range(most_ma + 1):
                    # A constant only for an undifferenced or once differenced series.
                    constant = [1] if differences < 2 else []
                    keep = [*constant, *range(2, 2 + p), *range(2 + most_ar, 2 + most_ar + q)]
                    free = len(keep) + 1
                    if n - free - 1 <= 0:
                        continue
                    b = full[keep, 0]
                    beta = np.linalg.lstsq(full[np.ix_(keep, keep)], b, rcond=None)[0] if keep else np.zeros(0)
                    sigma2 = max((full[0, 0] - float(beta @ b)) / n, 1e-300)
                    aicc = n * math.log(sigma2) + 2 * free + 2 * free * (free + 1) / (n - free - 1)
                    ar, ma = beta[len(constant) : len(constant) + p], beta[len(constant) + p :]
                    steady = all(
                        not len(part) or np.all(np.abs(np.roots([*part[::-1] * sign, 1.0])) > 1.001)
                        for part, sign in ((ar, -1.0), (ma, 1.0))
                    )
                    if steady and (best is None or aicc < best[-1]):
                        c = float(beta[0]) if constant else 0.0
                        best = (p, q, c, ar.tolist(), ma.tolist(), sigma2, aicc)
            out.append(best or (0, 0, 0.0, [], [], full[0, 0] / max(n, 1), None))
        return pd.DataFrame(out, columns=["p", "q", "constant", "ar", "ma", "sigma2", "aicc"])

    return solve


def _arma_forecaster(h: int):
    @F.pandas_udf("array<struct<step int, mean double, low double, high double>>")
    def run(model: pd.DataFrame, d: pd.Series, levels: pd.Series, w: pd.Series, e: pd.Series, scale: pd.Series) -> pd.Series:
        out = []
        for (_, m), differences, last, recent, shocks, size in zip(model.iterrows(), d, levels, w, e, scale):
            ar, ma = np.asarray(m.ar, float), np.asarray(m.ma, float)
            past, noise = list(recent), list(shocks)
            for _ in range(h):
                step = m.constant + sum(a * past[-1 - i] for i, a in enumerate(ar) if i < len(past))
                step += sum(b * noise[-1 - i] for i, b in enumerate(ma) if i < len(noise))
                past.append(step)
                noise.append(0.0)
            path = np.asarray(past[-h:])
            # Weights of past shocks on the differenced scale, then summed up once per difference.
            psi = [1.0]
            for j in range(1, h):
                psi.append((ma[j - 1] if j <= len(ma) else 0.0) + sum(a * psi[j - 1 - i] for i, a in enumerate(ar) if i < j))
            psi = np.asarray(psi)
            tail = np.asarray(last, float)
            for k in range(int(differences), 0, -1):
                base = np.diff(tail, k - 1)[-1]
                path, psi = base + np.cumsum(path), np.cumsum(psi)
            spread = Z_975 * np.sqrt(m.sigma2 * np.cumsum(psi * psi))
            out.append(
                [
                    {"step": i + 1, "mean": v * size, "low": (v - s) * size, "high": (v + s) * size}
                    for i, (v, s) in enumerate(zip(path.tolist(), spread.tolist()))
                ]
            )
        return pd.Series(out)

    return run


def _last(column: str, n: int) -> Column:
    """The last ``n`` values of a series in time order (rows are pre-filtered to the tail)."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("t", column))))
    values = F.transform(pairs, lambda s: s[column])
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def _arima_fit(
    series: DataFrame, keys: Sequence[str], most_ar: int, most_ma: int, long_ar: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with their lags, and one model per series."""
    # One row per period: small next to the facts, and read by several passes.
    clean = materialize(series.where(F.col("value").isNotNull()).select(*keys, "t", "value"), "series")
    orders = difference_order(clean, keys)
    whole = Window.partitionBy(*keys)
    scale = F.greatest(F.max(F.abs("value")).over(whole), F.lit(1e-300))
    rows = clean.join(orders, keys).select(*keys, "t", "d", scale.alias("scale"), (F.col("value") / scale).alias("value"))
    rows = rows.withColumn("__d1", F.col("value") - lag_of("value", 1, keys))
    rows = rows.withColumn("__d2", F.col("__d1") - lag_of("__d1", 1, keys))
    rows = rows.withColumn("w", F.when(F.col("d") == 0, F.col("value")).when(F.col("d") == 1, F.col("__d1")).otherwise(F.col("__d2")))
    lags = {f"__w{k}": lag_of("w", k, keys) for k in range(1, max(long_ar, most_ar) + 1)}
    rows = rows.withColumns(lags)

    # A series shorter than the long autoregression is filled with its mean step, so it stays in.
    mean = F.avg("w").over(whole)
    filled = [F.coalesce(F.col(f"__w{k}"), mean).alias(f"__f{k}") for k in range(1, long_ar + 1)]
    rows = rows.select("*", *filled)
    first = gram(rows, keys, [F.col("w"), F.lit(1.0), *[F.col(f"__f{k}") for k in range(1, long_ar + 1)]])
    first = first.select(*keys, _long_ar_solver(long_ar)("gram", "rows").alias("__beta"))
    rows = rows.join(first, keys)
    fit = F.col("__beta")[0] + sum(F.col("__beta")[k] * F.col(f"__f{k}") for k in range(1, long_ar + 1))
    rows = rows.withColumn("e", F.col("w") - fit)
    shocks = {f"__e{k}": lag_of("e", k, keys) for k in range(1, most_ma + 1)}
    rows = materialize(rows.withColumns(shocks), "lags")

    columns = [F.col("w"), F.lit(1.0)]
    columns += [F.col(f"__w{k}") for k in range(1, most_ar + 1)]
    columns += [F.col(f"__e{k}") for k in range(1, most_ma + 1)]
    second = gram(rows, [*keys, "d"], columns)
    models = second.select(*keys, "d", _arma_solver(most_ar, most_ma)("gram", "rows", "d").alias("model"))
    return rows, models


def arima_forecast(
    series: DataFrame, keys: Sequence[str], h: int, most_ar: int = 3, most_ma: int = 2, long_ar: int = 6
) -> DataFrame:
    """ARIMA with automatic order: differences by unit-root test, AR and MA orders by AICc.

    Coefficients are the two-stage least squares of Hannan and Rissanen (1982): residuals of a
    long autoregression stand in for the shocks of the ARMA regression. Equations that need a
    missing period are left out; a forecast starts from the last known values.
    """
    keys = list(keys)
    rows, models = _arima_fit(series, keys, most_ar, most_ma, long_ar)
    whole = Window.partitionBy(*keys)
    tail = rows.withColumn("__back", F.max("t").over(whole) - F.col("t")).where(F.col("__back") < most_ar + most_ma + 3)
    ends = tail.groupBy(*keys).agg(
        F.max("t").alias("last_t"),
        F.first("scale").alias("scale"),
        _last("value", 3).alias("__levels"),
        _last("w", max(most_ar, 1)).alias("__recent"),
        _last("e", max(most_ma, 1)).alias("__shocks"),
    )
    paths = models.join(ends, keys).withColumn(
        "path", _arma_forecaster(h)("model", "d", "__levels", "__recent", "__shocks", "scale")
    )
    flat = paths.select(*keys, "last_t", "d", "model", F.explode("path").alias("f"))
    return flat.select(
        *keys,
        (F.col("last_t") + F.col("f.step")).alias("t"),
        F.col("f.mean").alias("mean"),
        F.col("f.low").alias("low"),
        F.col("f.high").alias("high"),
        F.col("model.p").alias("p"),
        "d",
        F.col("model.q").alias("q"),
    )


def arima_residuals(
    series: DataFrame, keys: Sequence[str], most_ar: int = 3, most_ma: int = 2, long_ar: int = 6
) -> DataFrame:
    """One-step residuals of the chosen model, with the number of its AR and MA terms."""
    keys = list(keys)
    rows, models = _arima_fit(series, keys, most_ar, most_ma, long_ar)
    joined = rows.join(models.drop("d"), keys)
    fit = F.col("model.constant")
    for name, count, lag in (("ar", most_ar, "__w"), ("ma", most_ma, "__e")):
        for k in range(1, count + 1):
            weight = F.get(F.col(f"model.{name}"), F.lit(k - 1))
            fit = fit + F.when(weight.isNull(), F.lit(0.0)).otherwise(weight * F.col(f"{lag}{k}"))
    residual = (F.col("w") - fit) * F.col("scale")
    kept = joined.select(*keys, "t", residual.alias("value"), (F.col("model.p") + F.col("model.q")).alias("terms"))
    return kept.where(F.col("value").isNotNull())


def future_band(
    ahead: np.ndarray, history: float, change: np.ndarray, sigma2: float, fitted: np.ndarray, seed: int, paths: int = 1000
) -> tuple:
    """10 % and 90 % points of a future trend around its straight continuation, by simulation.

    Slopes go on changing as often as in the past (``change`` within ``history``), by Laplace draws of the past mean size;
    the uncertainty of the ``fitted`` trend there (its covariance) and noise of variance ``sigma2`` are added. The draws
    depend on the seed alone.
    """
    rng = np.random.default_rng(seed)
    drift = np.zeros((paths, len(ahead)))
    if len(ahead) and len(change) and history > 0:
        counts = rng.poisson(len(change) / history * ahead[-1], paths)
        owner = np.repeat(np.arange(paths), counts)
        when, size = rng.uniform(0, ahead[-1], len(owner)), rng.laplace(0, float(np.abs(change).mean()) + 1e-12, len(owner))
        for step, at in enumerate(ahead):
            drift[:, step] = np.bincount(owner, size * np.maximum(at - when, 0.0), paths)
    if len(ahead):
        drift += rng.multivariate_normal(np.zeros(len(ahead)), fitted, paths, check_valid="ignore")
    noisy = drift + rng.normal(0, math.sqrt(sigma2), drift.shape)
    return tuple(np.quantile(noisy, [0.1, 0.9], axis=0)) if len(ahead) else (np.zeros(0), np.zeros(0))


def changepoint_trend(
    series: DataFrame, keys: Sequence[str], h: int, changepoints: int = 25, history: float = 0.8, prior: float = 0.05
) -> DataFrame:
    """Piecewise-linear trend on the day axis with sparse changes of slope (Taylor & Letham 2018).

    ``series`` needs a date column ``ds``. Changes of slope have a Laplace prior, solved as a
    reweighted ridge regression. A group is one series of one row per period. The band holds 80 %
    of the noise, and beyond the last period of simulated further changes too: see ``future_band``.
    """
    keys = list(keys)
    fields = series.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", ds date, fitted boolean, yhat double, yhat_lower double, yhat_upper double, n_changes int"

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.dropna(subset=["value"]).sort_values("ds")
        if group.empty:
            return pd.DataFrame()
        dates = pd.to_datetime(group["ds"])
        ahead = pd.date_range(dates.iloc[-1], periods=h + 1, freq=pd.DateOffset(**{future_unit(dates): 1}))[1:]
        everything = pd.DatetimeIndex([*dates, *ahead])
        days = (everything - everything[0]).days.to_numpy(float)
        n = len(dates)
        span, size = max(days[n - 1], 1.0), max(float(np.abs(group["value"]).max()), 1e-300)
        t, y = days / span, group["value"].to_numpy(float) / size
        inside = int(math.floor(n * history))
        count = max(min(changepoints, inside - 1), 0)
        at = t[np.round(np.linspace(0, inside - 1, count + 1)).astype(int)][1:] if count else np.zeros(0)
        design = np.column_stack([np.ones_like(t), t, *[np.maximum(t - c, 0.0) for c in at]])
        x = design[:n]
        # Start from the free fit; the smoothing of |change| is lowered step by step.
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        for step in range(80):
            change, smooth = np.abs(beta[2:]), max(0.7**step, 1e-7)
            sigma2 = max(float(np.mean((y - x @ beta) ** 2)), 1e-8)
            penalty = np.diag([1 / 25.0, 1 / 25.0, *(1 / (prior * (change + smooth)))])
            beta = np.linalg.solve(x.T @ x / sigma2 + penalty, x.T @ y / sigma2)
        change, sigma2 = beta[2:], max(float(np.mean((y - x @ beta) ** 2)), 1e-8)
        yhat, band = design @ beta * size, Z_900 * math.sqrt(sigma2) * size
        out = pd.DataFrame({"ds": everything.date, "fitted": np.arange(len(days)) < n, "yhat": yhat})
        low, high = np.full(len(days), -band), np.full(len(days), band)
        seed = zlib.crc32("|".join(str(group[key].iloc[0]) for key in keys).encode())
        spread = design[n:] @ np.linalg.inv(x.T @ x / sigma2 + penalty) @ design[n:].T
        low[n:], high[n:] = (v * size for v in future_band(t[n:] - t[n - 1], t[inside - 1], change, sigma2, spread, seed))
        out["yhat_lower"], out["yhat_upper"] = out["yhat"] + low, out["yhat"] + high
        out["n_changes"] = int(np.sum(np.abs(change) > 1e-3))
        for key in keys:
            out[key] = group[key].iloc[0]
        return out[[*keys, "ds", "fitted", "yhat", "yhat_lower", "yhat_upper", "n_changes"]]

    def future_unit(dates: pd.Series) -> str:
        gap = float(dates.diff().dt.days.median()) if len(dates) > 1 else 365.0
        return "years" if gap > 180 else "months" if gap > 20 else "days"

    return series.select(*keys, "ds", "value").groupBy(*keys).applyInPandas(fit, schema)
