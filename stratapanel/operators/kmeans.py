"""k-means: single fits with restarts, and many configurations iterated together."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.operators.partials import emitted, total
from stratapanel.operators.scores import silhouette_squared
from stratapanel.session import materialize


#: Weighted points of the summary that all starts are first run on.
SUMMARY = 4096
#: Share of its sum of squares that a start must gain in a pass to go on, and the best start at the end.
GAIN, LAST_GAIN = 1e-3, 1e-8


def weighted_summary(rows: DataFrame, dims: Sequence[str], most: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` weighted points that stand for the whole table: counts and means by the cells of a grid.

    The grid has equally many steps over the range of every dimension; with too many dimensions for two steps each there
    is no summary, and both arrays are empty.
    """
    steps = int(most ** (1 / len(dims)) + 1e-9)
    if steps < 2:
        return np.zeros((0, len(dims))), np.zeros(0)
    ends = rows.agg(*[f(d) for d in dims for f in (F.min, F.max)]).first()
    cells = []
    for i, d in enumerate(dims):
        low, high = ends[2 * i], ends[2 * i + 1]
        width = (high - low) / steps if low is not None and high > low else 1.0
        cells.append(F.least(F.floor((F.col(d) - F.lit(low)) / F.lit(width)), F.lit(steps - 1)))
    found = rows.groupBy(*[c.alias(f"__c{i}") for i, c in enumerate(cells)]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(d).alias(d) for d in dims])
    table = np.array([list(r) for r in found.select("n", *dims).orderBy(*dims).collect()], float).reshape(-1, len(dims) + 1)
    return table[:, 1:], table[:, 0]


def lloyd(x: np.ndarray, weights: np.ndarray, centres: np.ndarray, iterations: int = 500) -> np.ndarray:
    """Weighted k-means of a few points to rest; a centre that loses all points stays where it is."""
    for _ in range(iterations):
        label = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, axis=1)
        n = np.bincount(label, weights, len(centres))
        sums = np.column_stack([np.bincount(label, weights * x[:, i], len(centres)) for i in range(x.shape[1])])
        new = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1.0)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return centres


def _settled(df: DataFrame, x: np.ndarray, weights: np.ndarray, starts: list[np.ndarray]) -> list[np.ndarray]:
    """Every start run to rest on the summary, each in a task; starts that came to rest at the same centres count once."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((x, weights, starts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, weights, starts = shared.value
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "centres": [lloyd(x, weights, starts[i]).tobytes() for i in batch["id"]]})

    ids = spark.range(len(starts)).repartition(min(len(starts), 2 * spark.sparkContext.defaultParallelism))
    found = ids.mapInPandas(run, "id bigint, centres binary").orderBy("id").collect()
    seen = {}
    for row in found:
        centres = np.frombuffer(row["centres"]).reshape(-1, x.shape[1])
        centres = centres[np.lexsort(centres.T[::-1])]
        seen.setdefault((len(centres), np.round(centres, 9).tobytes()), centres)
    return list(seen.values())


def _starts(rows: DataFrame, dims: Sequence[str], k: int, starts: int, seed: int) -> list[np.ndarray]:
    """``starts`` sets of ``k`` distinct points, in the order of a hash of their coordinates.

    The order does not depend on how the rows are stored. With too few distinct points the sets overlap.
    """
    order = F.xxhash64(*dims, F.lit(seed))
    points = np.array([list(r) for r in rows.select(*dims).distinct().orderBy(order, *dims).limit(k * starts).collect()], float)
    if not len(points):
        return []
    k = min(k, len(points))
    return [points[(np.arange(k) + s * k) % len(points)] for s in range(starts)]


def _best_fits(df: DataFrame, dims: Sequence[str], ks: Sequence[int], starts: int, seed: int) -> dict[int, tuple[np.ndarray, float]]:
    """For each number of clusters the best of several fits, and its sum of squares; all share their passes.

    The starts come to rest on a summary of the whole table first, so that few passes over the rows are left, and starts
    that meet there go on as one. All go on over the rows until a pass gains less than ``GAIN``; the best one of each number
    of clusters then goes on until a pass gains less than ``LAST_GAIN``.
    """
    dims = list(dims)
    rows = materialize(df.select(*dims).dropna(), "points", rebalance=True)
    most = _starts(rows, dims, max(ks), starts, seed)
    if not most:
        raise ValueError("no complete rows to cluster")
    first = [centres for k in ks for centres in (most if k == max(ks) else _starts(rows, dims, k, starts, seed))]
    x, weights = weighted_summary(rows, dims)
    runs = dict(enumerate(_settled(rows, x, weights, first) if len(x) else first))
    same = (np.zeros(len(dims)), np.eye(len(dims)))
    fitted = kmeans_many(rows, dims, dict.fromkeys(runs, same), runs, gain=GAIN)
    best: dict[int, tuple[float, int]] = {}
    for c, cost in costs_many(rows, dims, fitted).items():
        k = len(fitted[c])
        best[k] = min(best.get(k, (np.inf, -1)), (cost, c))
    final = kmeans_many(rows, dims, dict.fromkeys(best, same), {k: fitted[c] for k, (_, c) in best.items()}, gain=LAST_GAIN)
    costs = costs_many(rows, dims, final)
    return {k: (final[min(k, max(final))], costs[min(k, max(final))]) for k in ks}


def costs_many(df: DataFrame, features: Sequence[str], centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Sum of squared distances to the nearest centre of every configuration, in one pass."""
    features, names = list(features), sorted(centres)
    shared = df.sparkSession.sparkContext.broadcast([centres[c] for c in names])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(shared.value), 1))
        for batch in batches:
            x = batch[features].to_numpy(float)
            for i, centre in enumerate(shared.value):
                near = np.argmin((centre**2).sum(axis=1)[None, :] - 2 * x @ centre.T, axis=1)
                sums[i] += ((x - centre[near]) ** 2).sum()
        yield emitted(sums)

    return dict(zip(names, total(df.select(*features), work, len(names), 1)[:, 0].tolist(), strict=True))


def kmeans_restarts(df: DataFrame, dims: Sequence[str], k: int, starts: int = 25, seed: int = 123) -> np.ndarray:
    """Centres of the best of several fits by within-cluster sum of squares."""
    return _best_fits(df, dims, [k], starts, seed)[k][0]


def _distance(dims: Sequence[str], centre: Sequence[float]) -> Column:
    terms = [(F.col(d) - F.lit(float(c))) * (F.col(d) - F.lit(float(c))) for d, c in zip(dims, centre, strict=True)]
    return sum(terms[1:], terms[0])


def nearest_centre(dims: Sequence[str], centres: Sequence[Sequence[float]], first: int = 1) -> Column:
    """Number of the nearest centre (ties to the lower number); NULL where a coordinate is missing."""
    options = [F.struct(_distance(dims, centre).alias("d"), F.lit(first + i).alias("c")) for i, centre in enumerate(centres)]
    known = F.lit(True)
    for d in dims:
        known = known & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double"))
    return F.when(known, F.least(*options)["c"] if len(options) > 1 else F.lit(first))


def assign(df: DataFrame, centres: np.ndarray, dims: Sequence[str], out: str = "cluster") -> DataFrame:
    """Label the points, clusters numbered from 1."""
    return df.withColumn(out, nearest_centre(dims, centres.tolist()))


def elbow(df: DataFrame, dims: Sequence[str], ks: Sequence[int], starts: int = 25, seed: int = 123) -> DataFrame:
    """Within-cluster sum of squares and silhouette for each number of clusters."""
    found = _best_fits(df, dims, list(ks), starts, seed)
    labels = [F.struct(F.lit(k).alias("k"), nearest_centre(dims, c.tolist()).alias("cluster"), *dims) for k, (c, _) in sorted(found.items())]
    points = df.select(*dims).select(F.inline(F.array(*labels)))
    scored = {r["k"]: r["silhouette"] for r in silhouette_squared(points, "cluster", dims, ["k"]).collect()}
    rows = [(k, float(cost), scored.get(k)) for k, (_, cost) in sorted(found.items())]
    return df.sparkSession.createDataFrame(rows, "k int, wss double, silhouette double")


def kmeans_many(
    df: DataFrame,
    features: Sequence[str],
    maps: dict[int, tuple[np.ndarray, np.ndarray]],
    centres: dict[int, np.ndarray],
    iterations: int = 100,
    tolerance: float = 1e-6,
    gain: float = 0.0,
) -> dict[int, np.ndarray]:
    """Lloyd iterations of many configurations, one pass over the data per iteration for all.

    ``maps[c]`` turns features into the configuration's scores (offset and matrix). A task adds up
    its own rows, so it emits one short table whatever it has read. A configuration rests when no centre moves by more than
    ``tolerance``, or when a pass lowers its sum of squares by no more than the share ``gain``.
    """
    features = list(features)
    source = df.select(*features).dropna()
    current = {c: np.array(v, float) for c, v in centres.items()}
    active, costs = set(current), dict.fromkeys(current, np.inf)
    context = df.sparkSession.sparkContext
    for _ in range(iterations):
        if not active:
            break
        names = sorted(active)
        ends = np.cumsum([0, *[len(current[c]) for c in names]])
        width = max(current[c].shape[1] for c in names) + 2
        shared = context.broadcast([(*maps[c], current[c]) for c in names])

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros((ends[-1], width))
            for batch in batches:
                x = batch[features].to_numpy(float)
                for (offset, matrix, centre), low, high in zip(shared.value, ends[:-1], ends[1:]):
                    y = (x - offset) @ matrix
                    distance = (centre**2).sum(axis=1)[None, :] - 2 * y @ centre.T
                    label = np.argmin(distance, axis=1)
                    sums[low, -1] += (y**2).sum() + distance[np.arange(len(y)), label].sum()
                    sums[low:high, 0] += np.bincount(label, minlength=len(centre))
                    for i in range(y.shape[1]):
                        sums[low:high, i + 1] += np.bincount(label, y[:, i], len(centre))
            yield emitted(sums)

        table = total(source, partial, ends[-1], width)
        for c, low, high in zip(names, ends[:-1], ends[1:]):
            old, n = current[c], table[low:high, :1]
            new = np.where(n > 0, table[low:high, 1 : old.shape[1] + 1] / np.where(n > 0, n, 1.0), old)
            current[c] = new
            cost, costs[c] = costs[c], table[low, -1]
            if float(np.abs(new - old).max()) <= tolerance or cost - costs[c] <= gain * cost < np.inf:
                active.discard(c)
        shared.unpersist()
    if active:
        warnings.warn(f"{len(active)} of {len(current)} configurations still moved after {iterations} passes", stacklevel=2)
    return current
