"""Principal components of standardised features.

All moments come from one aggregation; the eigenproblem is as small as the number of features, and
any subset of features reuses the same matrix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Moments:
    columns: list[str]
    mean: np.ndarray
    sd: np.ndarray
    correlation: np.ndarray

    def subset(self, columns: Sequence[str]) -> Moments:
        at = [self.columns.index(c) for c in columns]
        return Moments(list(columns), self.mean[at], self.sd[at], self.correlation[np.ix_(at, at)])


@dataclass(frozen=True)
class Components:
    moments: Moments
    loadings: np.ndarray
    variance: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return self.variance / self.variance.sum()


def moments_of(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Means, deviations and correlations over rows complete in all columns."""
    columns = list(columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    row = (
        df.select(*columns)
        .dropna()
        .agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
            *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
        )
        .first()
    )
    sd = np.array([row[f"s{i}"] or 0.0 for i in range(len(columns))])
    if not np.all(sd > 0):
        raise ValueError(f"no variation in {[c for c, s in zip(columns, sd) if not s > 0]}")
    correlation = np.eye(len(columns))
    for i, j in pairs:
        correlation[i, j] = correlation[j, i] = row[f"c{i}_{j}"] / (sd[i] * sd[j])
    return Moments(columns, np.array([row[f"m{i}"] for i in range(len(columns))]), sd, correlation)


def components_of(moments: Moments) -> Components:
    """Loadings by falling variance; the sign makes the largest loading of each positive."""
    values, vectors = np.linalg.eigh(moments.correlation)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.clip(values[order], 0.0, None), vectors[:, order]
    largest = np.argmax(np.abs(vectors).round(9), axis=0)
    signs = np.sign(vectors[largest, np.arange(vectors.shape[1])])
    return Components(moments, vectors * np.where(signs == 0, 1.0, signs), values)


def score_columns(model: Components, n: int, prefix: str = "pc") -> list[Column]:
    """The first ``n`` scores as plain column expressions."""
    m = model.moments
    result = []
    for j in range(n):
        terms = [
            (F.col(c) - F.lit(float(m.mean[i]))) * F.lit(float(model.loadings[i, j] / m.sd[i]))
            for i, c in enumerate(m.columns)
        ]
        result.append(sum(terms[1:], terms[0]).alias(f"{prefix}{j + 1}"))
    return result


def scores(df: DataFrame, model: Components, keys: Sequence[str], n: int) -> DataFrame:
    rows = df.dropna(subset=model.moments.columns)
    return rows.select(*keys, *score_columns(model, n))


def summary(spark: SparkSession, model: Components) -> DataFrame:
    share = model.share
    rows = [
        (f"PC{j + 1}", float(np.sqrt(v)), float(share[j]), float(share[: j + 1].sum()))
        for j, v in enumerate(model.variance)
    ]
    return spark.createDataFrame(rows, "component string, sdev double, share double, cumulative double")


def contributions(spark: SparkSession, model: Components) -> DataFrame:
    """Loadings, biplot coordinates (loading x sdev) and contribution of each variable in percent."""
    rows = [
        (
            name,
            f"PC{j + 1}",
            float(model.loadings[i, j]),
            float(model.loadings[i, j] * np.sqrt(model.variance[j])),
            float(100.0 * model.loadings[i, j] ** 2),
        )
        for i, name in enumerate(model.moments.columns)
        for j in range(len(model.variance))
    ]
    schema = "feature string, component string, loading double, coordinate double, contribution double"
    return spark.createDataFrame(rows, schema)


def model_table(spark: SparkSession, model: Components) -> DataFrame:
    """The fitted model as a table, to be stored with ``save_catalog``."""
    m = model.moments
    rows = [
        (name, float(m.mean[i]), float(m.sd[i]), [float(v) for v in model.loadings[i]], [float(v) for v in model.variance])
        for i, name in enumerate(m.columns)
    ]
    return spark.createDataFrame(rows, "feature string, mean double, sd double, loadings array<double>, variance array<double>")
