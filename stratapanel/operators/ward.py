"""Ward clustering of any number of points, through weighted micro-clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stratapanel.operators.kmeans import kmeans_many
from stratapanel.session import materialize


@dataclass(frozen=True)
class MicroClusters:
    centres: np.ndarray
    weights: np.ndarray
    label: Callable[[DataFrame], DataFrame]


def micro_clusters(df: DataFrame, dims: Sequence[str], most: int = 500, seed: int = 123) -> MicroClusters:
    """At most ``most`` weighted k-means centres, started from distinct points in the order of a hash.

    ``most`` bounds what reaches the driver. The way is the same at every size: where there are no
    more distinct points, each is its own centre. ``label`` adds the number of a row's centre as ``micro``.
    """
    dims = list(dims)
    rows = materialize(df.select(*dims).dropna(), "points", rebalance=True)
    order = F.xxhash64(*dims, F.lit(seed))
    starts = [list(r) for r in rows.distinct().orderBy(order, *dims).limit(most).collect()]
    if not starts:
        return MicroClusters(np.zeros((0, len(dims))), np.zeros(0), lambda d: d.dropna(subset=dims).withColumn("micro", F.lit(0)))
    same = (np.zeros(len(dims)), np.eye(len(dims)))
    centres = kmeans_many(rows, dims, {0: same}, {0: np.array(starts, float)}, iterations=20)[0]
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(*columns: pd.Series) -> pd.Series:
        x, centre = np.column_stack([c.to_numpy(float) for c in columns]), shared.value
        near = (centre**2).sum(axis=1)[None, :] - 2 * x @ centre.T
        return pd.Series(near.argmin(axis=1).astype("int32"))

    def label(d: DataFrame) -> DataFrame:
        return d.dropna(subset=dims).withColumn("micro", nearest(*[F.col(c).cast("double") for c in dims]))

    weights = np.zeros(len(centres))
    for r in label(rows).groupBy("micro").agg(F.count(F.lit(1)).alias("n")).collect():
        weights[r["micro"]] = r["n"]
    return MicroClusters(centres, weights, label)


def ward_cuts(centres: np.ndarray, weights: np.ndarray, ks: Sequence[int]) -> dict[int, np.ndarray]:
    """Groups (from 1) of weighted centres at each wanted number of clusters.

    One run of merges by least increase of the sum of squares serves all the cuts.
    """
    x, w = centres.astype(float).copy(), weights.astype(float).copy()
    alive = np.ones(len(x), bool)
    group = np.arange(len(x))

    def costs(i: int) -> np.ndarray:
        cost = ((x - x[i]) ** 2).sum(axis=1) * w * w[i] / (w + w[i])
        cost[~alive] = np.inf
        cost[i] = np.inf
        return cost

    table = np.array([costs(i) for i in range(len(x))])
    cuts = {}
    for left in range(len(x), 0, -1):
        if left in ks:
            cuts[left] = np.unique(group, return_inverse=True)[1] + 1
        if left <= min(ks):
            break
        i, j = sorted(divmod(int(np.argmin(table)), len(x)))
        x[i] = (x[i] * w[i] + x[j] * w[j]) / (w[i] + w[j])
        w[i] += w[j]
        alive[j] = False
        group[group == j] = i
        table[j, :] = table[:, j] = np.inf
        table[i, :] = table[:, i] = costs(i)
    return cuts


def ward(df: DataFrame, dims: Sequence[str], k: int, most: int = 500, out: str = "cluster") -> DataFrame:
    """Label every complete row with its micro-cluster's Ward group, numbered from 1.

    With no more than ``most`` distinct points the tree is the exact one.
    """
    dims = list(dims)
    micro = micro_clusters(df, dims, most)
    used = np.flatnonzero(micro.weights > 0)
    groups = np.zeros(len(micro.weights), int)
    groups[used] = ward_cuts(micro.centres[used], micro.weights[used], [min(k, len(used))])[min(k, len(used))]
    group_of = F.array(*[F.lit(int(g)) for g in groups])
    return micro.label(df).withColumn(out, group_of[F.col("micro")]).drop("micro")
