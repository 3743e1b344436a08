"""Quality of a clustering, for one labelling or for many configurations in one job.

Points are rows ``(configuration keys, label, dimension columns)``. Cluster sums are aggregated
first; a point then needs only the list of its configuration's clusters. Where the list is long, points are dealt into parts
that meet it as arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.session import materialize

#: A list of up to so many clusters is walked row by row.
SHORT = 64
#: Rows of a part that meets a longer one, and distances held at a time.
PART, DISTANCES = 50_000, 1_000_000


def _dot(x: Sequence[str], centre: Column) -> Column:
    terms = [F.col(d) * centre[i] for i, d in enumerate(x)]
    return sum(terms[1:], terms[0])


def _square(x: Sequence[str]) -> Column:
    terms = [F.col(d) * F.col(d) for d in x]
    return sum(terms[1:], terms[0])


def _not_noise(points: DataFrame, label: str, noise) -> DataFrame:
    return points if noise is None else points.where(F.col(label) != noise)


def cluster_sums(points: DataFrame, by: Sequence[str], label: str, dims: Sequence[str]) -> DataFrame:
    """Size, coordinate sums and sum of squared norms per cluster."""
    return points.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(d) for d in dims]).alias("s"),
        F.sum(_square(dims)).alias("q"),
    )


def _join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach per-configuration results: a short table of known size, or one row as a subquery."""
    if by:
        return left.join(materialize(right, "clusters"), list(by))
    names = right.columns
    packed = right.select(F.struct(*names).alias("__r")).scalar()
    return left.withColumn("__r", packed).select("*", *[F.col("__r")[n].alias(n) for n in names]).drop("__r")


def _by_length(clusters: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Clusters of configurations with a short list and, if there are any, of those with a long one."""
    if not by:
        return clusters, None
    clusters = materialize(clusters, "sums")
    long = materialize(clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > SHORT).select(*by), "long")
    if long.isEmpty():
        return clusters, None
    return clusters.join(long, list(by), "left_anti"), materialize(clusters.join(long, list(by)), "many")


def _dealt(rows: DataFrame, counts: DataFrame, clusters: DataFrame, by: Sequence[str], work) -> DataFrame:
    """``total`` and ``number`` of each part of a configuration's rows, which ``work`` makes of it and all its clusters."""
    parts = materialize(counts.select(*by, F.ceil(F.col("n") / PART).alias("__parts")), "parts")
    own = [c for c in rows.columns if c not in by]
    left = rows.join(parts, list(by)).withColumn("__part", F.pmod(F.xxhash64(*own), F.col("__parts"))).drop("__parts")
    right = clusters.join(parts, list(by)).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    keys = [*by, "__part"]

    def run(part: pd.DataFrame, all_clusters: pd.DataFrame) -> pd.DataFrame:
        total, number = work(part, all_clusters) if len(part) else (0.0, 0)
        return pd.concat([all_clusters[list(by)].head(1).reset_index(drop=True), pd.DataFrame({"total": [total], "number": [number]})], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "total double, number long"])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _silhouettes_of_many(rows: DataFrame, sums: DataFrame, by: Sequence[str], label: str, dims: Sequence[str]) -> DataFrame:
    """Mean silhouette of configurations with many clusters, all of at least two."""
    dims = list(dims)

    def work(part: pd.DataFrame, clusters: pd.DataFrame) -> tuple[float, int]:
        n, s, q = clusters["n"].to_numpy(float), np.stack(clusters["s"]), clusters["q"].to_numpy(float)
        at = pd.Index(clusters[label]).get_indexer(part[label])
        x, total = part[dims].to_numpy(float), 0.0
        step = max(1, DISTANCES // len(n))
        for low in range(0, len(x), step):
            y, mine = x[low : low + step], at[low : low + step]
            distance = (y**2).sum(axis=1)[:, None] + (q - 2 * y @ s.T) / n
            distance = np.maximum(np.where(np.isnan(y).any(axis=1)[:, None], 0.0, distance), 0.0)
            place = np.arange(len(y))
            a = distance[place, mine] * n[mine] / np.maximum(n[mine] - 1, 1)
            distance[place, mine] = np.inf
            b = distance.min(axis=1)
            high = np.maximum(a, b)
            total += float(np.where((n[mine] > 1) & (high > 0), (b - a) / np.where(high > 0, high, 1.0), 0.0).sum())
        return total, len(x)

    counts = sums.groupBy(*by).agg(F.sum("n").alias("n"))
    found = _dealt(rows.select(*by, label, *dims), counts, sums, by, work)
    return found.groupBy(*by).agg((F.sum("total") / F.sum("number")).alias("silhouette"))


def _davies_bouldin_of_many(clusters: DataFrame, by: Sequence[str]) -> DataFrame:
    """The index of configurations with many clusters, from their centres ``__c`` and scatters ``__s``."""

    def work(part: pd.DataFrame, clusters: pd.DataFrame) -> tuple[float, int]:
        centre, scatter = np.stack(clusters["__c"]), clusters["__s"].to_numpy(float)
        at, total = pd.Index(clusters["__l"]).get_indexer(part["__l"]), 0.0
        step = max(1, DISTANCES // len(centre))
        for low in range(0, len(at), step):
            mine = at[low : low + step]
            square = sum((centre[mine, i][:, None] - centre[None, :, i]) ** 2 for i in range(centre.shape[1]))
            square[np.arange(len(mine)), mine] = 0.0
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(square > 0, (scatter[mine][:, None] + scatter) / np.sqrt(square), -1.0)
            worst = ratio.max(axis=1)
            total += float(np.where(worst < 0, np.nan, worst).sum())  # no other centre elsewhere: no index
        return total, len(at)

    counts = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    found = _dealt(materialize(clusters.select(*by, "__l"), "labels"), counts, clusters.select(*by, "__l", "__c", "__s"), by, work)
    index = F.sum("total") / F.sum("number")
    return found.groupBy(*by).agg(F.when(~F.isnan(index), index).alias("db_index"))


def silhouette_squared(
    points: DataFrame, label: str, dims: Sequence[str], by: Sequence[str] = (), noise=None
) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, exact and linear in the points times the clusters of a configuration.

    The mean squared distance from x to a cluster is |x|^2 - 2 x.s/n + q/n. A singleton scores 0;
    fewer than two clusters give NULL.
    """
    rows = _not_noise(points, label, noise).where(F.col(label).isNotNull())
    every = rows
    sums, many = _by_length(cluster_sums(rows, by, label, dims), by)
    if many is not None:
        rows = rows.join(many.select(*by).distinct(), list(by), "left_anti")
    packed = sums.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "s", "q")).alias("__c"))
    joined = _join(rows.select(*by, label, *dims, _square(dims).alias("__x2")), packed, by)
    x2, own_label = F.col("__x2"), F.col(label)

    def mean_square(c: Column) -> Column:
        return F.greatest(x2 + (c["q"] - 2 * _dot(dims, c["s"])) / c["n"], F.lit(0.0))

    # One walk over the clusters: size and distance of the own one, least distance of the others.
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("own"), none.alias("b"))
    walk = F.aggregate(
        "__c",
        start,
        lambda acc, c: F.when(
            c["l"] == own_label, F.struct(c["n"].alias("n"), mean_square(c).alias("own"), acc["b"].alias("b"))
        ).otherwise(
            F.struct(acc["n"].alias("n"), acc["own"].alias("own"), F.least(acc["b"], mean_square(c)).alias("b"))
        ),
    )
    joined = joined.withColumn("__w", walk).select(
        *by, F.col("__w.n").alias("__n"), F.col("__w.own").alias("__own"), F.col("__w.b").alias("__b")
    )
    a = F.try_divide(F.col("__own") * F.col("__n"), F.col("__n") - 1)
    width = F.when(F.col("__b").isNull(), F.lit(None).cast("double")).otherwise(
        F.when(F.col("__n") == 1, 0.0).otherwise(
            F.coalesce(F.try_divide(F.col("__b") - a, F.greatest(a, F.col("__b"))), F.lit(0.0))
        )
    )
    found = joined.groupBy(*by).agg(F.avg(width).alias("silhouette"))
    if many is None:
        return found
    wanted = every.join(many.select(*by).distinct(), list(by), "left_semi")
    return found.unionByName(_silhouettes_of_many(wanted, many, by, label, dims))


def davies_bouldin(
    points: DataFrame, label: str, dims: Sequence[str], by: Sequence[str] = (), noise=None
) -> DataFrame:
    """Davies-Bouldin index: root-mean-square scatter, Euclidean distance between centres."""
    rows = _not_noise(points, label, noise).where(F.col(label).isNotNull())
    k = len(dims)
    centred = F.transform("s", lambda v: v / F.col("n"))
    centre_square = F.aggregate("__c", F.lit(0.0), lambda acc, v: acc + v * v)
    clusters = (
        cluster_sums(rows, by, label, dims)
        .withColumn("__c", centred)
        .withColumn("__s", F.sqrt(F.greatest(F.col("q") / F.col("n") - centre_square, F.lit(0.0))))
    )
    clusters, many = _by_length(clusters, by)
    packed = clusters.groupBy(*by).agg(F.collect_list(F.struct(F.col(label).alias("l"), "__c", "__s")).alias("c"))

    def gap(a: Column, b: Column) -> Column:
        terms = [(a["__c"][i] - b["__c"][i]) * (a["__c"][i] - b["__c"][i]) for i in range(k)]
        return F.sqrt(sum(terms[1:], terms[0]))

    worst = F.transform(
        "c",
        lambda a: F.array_max(
            F.transform(
                F.filter("c", lambda b: b["l"] != a["l"]), lambda b: F.try_divide(a["__s"] + b["__s"], gap(a, b))
            )
        ),
    )
    total = F.aggregate("__w", F.lit(0.0), lambda acc, v: acc + v)
    found = packed.withColumn("__w", worst).select(*by, F.try_divide(total, F.size("__w")).alias("db_index"))
    return found if many is None else found.unionByName(_davies_bouldin_of_many(many.withColumn("__l", F.col(label)), by))


def balance(points: DataFrame, label: str, by: Sequence[str] = (), noise=0) -> DataFrame:
    """Clusters found (noise left out), largest over smallest size, and share of noise or unlabelled."""
    missing = F.col(label).isNull() | (F.col(label) == noise)
    sizes = points.groupBy(*by, F.when(~missing, F.col(label)).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    real = F.col("__l").isNotNull()
    n = F.when(real, F.col("__n"))
    return sizes.groupBy(*by).agg(
        F.count("__l").alias("num_clusters"),
        F.when(F.count("__l") > 1, F.max(n) / F.min(n)).alias("max_min_ratio"),
        (F.coalesce(F.sum(F.when(~real, F.col("__n"))), F.lit(0)) / F.sum("__n")).alias("missing_rate"),
    )


def profile(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean of each feature by cluster and its log10(mean + 1), in long form."""
    means = df.groupBy(label).agg(*[F.avg(f).alias(f) for f in features])
    long = means.unpivot([label], list(features), "feature", "mean")
    return long.withColumn("log_mean", F.log10(F.col("mean") + 1))
