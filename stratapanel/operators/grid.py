"""Search over feature subsets, numbers of components and clustering settings.

All k-means and Ward configurations share one correlation matrix, one set of micro-clusters and
the same passes over the data; only one short row per configuration reaches the driver. All density
settings of all reductions to as many components share one plan and are scored where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratapanel.functions.columns import is_finite
from stratapanel.operators import pca, scores
from stratapanel.operators.density_grid import dbscan_many
from stratapanel.operators.features import rescale, zscore
from stratapanel.operators.kmeans import kmeans_many
from stratapanel.operators.ward import micro_clusters, ward_cuts
from stratapanel.session import materialize

RESULT_SCHEMA = (
    "method string, features array<string>, n_pc int, params map<string,double>, num_clusters bigint, "
    "silhouette double, db_index double, max_min_ratio double, missing_rate double"
)


def feature_subsets(spark: SparkSession, names: Sequence[str], least: int = 2, most: int | None = None) -> DataFrame:
    """All subsets of at least two features, as bit masks filled in by Spark."""
    n = len(names)
    masks = spark.range(1 << n).withColumn("size", F.bit_count("id"))
    masks = masks.where(F.col("size").between(least, most or n))
    members = F.array(*[F.when(F.col("id").bitwiseAND(1 << i) != 0, F.lit(name)) for i, name in enumerate(names)])
    return masks.select(F.col("id").alias("mask"), F.col("size").cast("int").alias("size"), F.array_compact(members).alias("features"))


def reductions(subsets: DataFrame, least_pc: int = 2, most_pc: int = 8) -> DataFrame:
    """Each subset with every number of components it can give."""
    counts = F.sequence(F.lit(least_pc), F.least(F.col("size"), F.lit(most_pc)))
    return subsets.where(F.col("size") >= least_pc).withColumn("n_pc", F.explode(counts))


@dataclass(frozen=True)
class Reduction:
    features: list[str]
    n_pc: int
    offset: np.ndarray
    matrix: np.ndarray


def _reduction(moments: pca.Moments, features: Sequence[str], n_pc: int) -> Reduction:
    """The scores of a subset as one linear map of all features."""
    model = pca.components_of(moments.subset(features))
    matrix = np.zeros((len(moments.columns), n_pc))
    for i, name in enumerate(features):
        at = moments.columns.index(name)
        matrix[at] = model.loadings[i, :n_pc] / moments.sd[at]
    return Reduction(list(features), n_pc, moments.mean, matrix)


def _labels(x: np.ndarray, y: np.ndarray, rule: tuple, micro: np.ndarray | None) -> np.ndarray:
    kind, table = rule
    if kind == "centres":
        return np.argmin((table**2).sum(axis=1)[None, :] - 2 * y @ table.T, axis=1)
    return table[micro]


def score_many(df: DataFrame, plan: dict[int, Reduction], rules: dict[int, tuple], micro: tuple | None) -> list[tuple]:
    """Silhouette (squared distance), Davies-Bouldin and sizes of every configuration in two passes.

    ``rules[c]`` is ``("centres", matrix)`` or ``("micro", group of each micro-cluster)``; ``micro``
    holds the micro-cluster centres with their own offset and scale.
    """
    features = df.columns
    context = df.sparkSession.sparkContext

    def memberships(batch: pd.DataFrame, shared: dict):
        x = batch[features].to_numpy(float)
        nearest = None
        if shared["micro"] is not None:
            centres, mean, sd = shared["micro"]
            z = (x - mean) / sd
            nearest = np.argmin((centres**2).sum(axis=1)[None, :] - 2 * z @ centres.T, axis=1)
        for c, (reduction, rule) in shared["plan"].items():
            y = (x - reduction.offset) @ reduction.matrix
            yield c, y, _labels(x, y, rule, nearest)

    count = {c: len(rule[1]) if rule[0] == "centres" else int(rule[1].max()) + 1 for c, rule in rules.items()}
    first = context.broadcast({"plan": {c: (plan[c], rules[c]) for c in rules}, "micro": micro})

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {c: np.zeros((count[c], plan_dim[c] + 2)) for c in count}
        for batch in batches:
            for c, y, label in memberships(batch, first.value):
                member = np.eye(count[c])[label]
                totals[c][:, 0] += member.sum(axis=0)
                totals[c][:, 1:-1] += member.T @ y
                totals[c][:, -1] += member.T @ (y**2).sum(axis=1)
        yield pd.DataFrame([(c, t.ravel().tolist()) for c, t in totals.items()], columns=["config", "sums"])

    plan_dim = {c: plan[c].n_pc for c in rules}
    exploded = df.mapInPandas(sums, "config int, sums array<double>").select("config", F.posexplode("sums"))
    rows = exploded.groupBy("config", "pos").agg(F.sum("col").alias("v")).collect()
    stats = {c: np.zeros(count[c] * (plan_dim[c] + 2)) for c in count}
    for r in rows:
        stats[r["config"]][r["pos"]] = r["v"]
    stats = {c: v.reshape(count[c], -1) for c, v in stats.items()}
    second = context.broadcast({"plan": {c: (plan[c], rules[c]) for c in rules}, "micro": micro, "stats": stats})

    def widths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = dict.fromkeys(count, 0.0)
        for batch in batches:
            for c, y, label in memberships(batch, second.value):
                n, s, q = (lambda t: (t[:, 0], t[:, 1:-1], t[:, -1]))(second.value["stats"][c])
                with np.errstate(divide="ignore", invalid="ignore"):
                    distance = (y**2).sum(axis=1)[:, None] + (q[None, :] - 2 * y @ s.T) / n[None, :]
                distance = np.maximum(np.where(n[None, :] > 0, distance, np.inf), 0.0)
                at = np.arange(len(y))
                a = distance[at, label] * n[label] / np.maximum(n[label] - 1, 1)
                distance[at, label] = np.inf
                b = distance.min(axis=1)
                high = np.maximum(a, b)
                ok = (n[label] > 1) & (high > 0) & np.isfinite(b)
                totals[c] += float(np.where(ok, (b - a) / np.where(ok, high, 1.0), 0.0).sum())
        yield pd.DataFrame(list(totals.items()), columns=["config", "total"])

    silhouettes = {
        r["config"]: r["t"]
        for r in df.mapInPandas(widths, "config int, total double").groupBy("config").agg(F.sum("total").alias("t")).collect()
    }
    return [(c, *_summary(stats[c], silhouettes.get(c, 0.0))) for c in sorted(count)]


def _summary(table: np.ndarray, silhouette_sum: float) -> tuple:
    table = table[table[:, 0] > 0]
    n, centre = table[:, 0], table[:, 1:-1] / table[:, :1]
    if len(n) < 2:
        return len(n), None, None, None
    scatter = np.sqrt(np.maximum(table[:, -1] / n - (centre**2).sum(axis=1), 0.0))
    gap = np.sqrt(((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (scatter[:, None] + scatter[None, :]) / gap
    np.fill_diagonal(ratio, -np.inf)
    return len(n), silhouette_sum / float(n.sum()), float(ratio.max(axis=1).mean()), float(n.max() / n.min())


def grid_search(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    plan: DataFrame,
    ks: Sequence[int] = (2, 3, 4),
    eps: Sequence[float] = (),
    min_pts: Sequence[int] = (),
    micro_limit: int = 500,
) -> DataFrame:
    """One scored row per configuration: k-means and Ward for every ``k``, DBSCAN for every
    ``eps`` and ``min_pts``. ``plan`` comes from ``reductions`` and fixes what is searched."""
    spark = df.sparkSession
    features = list(features)
    points = materialize(df.select(key, *features).dropna(), "grid")
    moments = pca.moments_of(points, features)
    todo = {i: _reduction(moments, r["features"], r["n_pc"]) for i, r in enumerate(plan.orderBy("mask", "n_pc").collect())}
    data = points.select(*features)
    micro = micro_clusters(zscore(data, features), features, micro_limit)
    used = micro.weights > 0
    centres, weights = micro.centres[used], micro.weights[used]
    ks = [k for k in ks if k <= len(centres)]
    cuts = _ward_everywhere(spark, todo, centres, weights, moments, ks) if ks else {}

    specs, rules, maps, starts = {}, {}, {}, {}
    for i, reduction in todo.items():
        mapped = (centres * moments.sd) @ reduction.matrix
        for k in ks:
            group = cuts[(i, k)]
            c = len(specs)
            specs[c] = ("Hierarchical", reduction, {"k": float(k)})
            rules[c] = ("micro", group)
            c = len(specs)
            specs[c] = ("KMeans", reduction, {"k": float(k)})
            maps[c] = (reduction.offset, reduction.matrix)
            # Ward's groups give the starting centres: same start every time, no restarts needed.
            starts[c] = np.array([np.average(mapped[group == g], axis=0, weights=weights[group == g]) for g in range(k)])
    for c, final in kmeans_many(data, features, maps, starts).items():
        rules[c] = ("centres", final)
    shared = (centres, moments.mean, moments.sd)
    scored = score_many(data, {c: s[1] for c, s in specs.items()}, rules, shared) if specs else []
    rows = [
        (specs[c][0], specs[c][1].features, specs[c][1].n_pc, specs[c][2], found, sil, db, ratio, 0.0)
        for c, found, sil, db, ratio in scored
    ]
    result = spark.createDataFrame(rows, RESULT_SCHEMA)
    if eps and min_pts:
        for n_pc in sorted({r.n_pc for r in todo.values()}):
            alike = {i: r for i, r in todo.items() if r.n_pc == n_pc}
            result = result.unionByName(_density_rows(points, key, alike, n_pc, eps, min_pts))
    return result


def _ward_everywhere(spark, todo, centres, weights, moments, ks) -> dict[tuple[int, int], np.ndarray]:
    """Ward cuts of every reduction; each works on the same few micro-clusters, in its own task."""
    shared = spark.sparkContext.broadcast((todo, centres * moments.sd, weights, list(ks)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, raw, w, wanted = shared.value
        for batch in batches:
            rows = [
                (int(i), int(k), (group - 1).tolist())
                for i in batch["id"]
                for k, group in ward_cuts(raw @ plan[int(i)].matrix, w, wanted).items()
            ]
            yield pd.DataFrame(rows, columns=["id", "k", "groups"])

    ids = spark.range(len(todo)).repartition(min(len(todo), 200))
    found = ids.mapInPandas(run, "id int, k int, groups array<int>").collect()
    return {(r["id"], r["k"]): np.array(r["groups"]) for r in found}


def reduced_points(points: DataFrame, key: str, moments: pca.Moments, features: Sequence[str], n_pc: int) -> DataFrame:
    return pca.scores(points, pca.components_of(moments.subset(features)), [key], n_pc)


def _reduced_spaces(points: DataFrame, key: str, plan: dict[int, Reduction], n_pc: int) -> DataFrame:
    """Every point once per reduction: ``space``, key and components."""
    features = [c for c in points.columns if c != key]
    shared = points.sparkSession.sparkContext.broadcast(plan)
    dims = [f"pc{j + 1}" for j in range(n_pc)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(float)
            for space, reduction in shared.value.items():
                out = pd.DataFrame((x - reduction.offset) @ reduction.matrix, columns=dims)
                out.insert(0, "key", batch[key].to_numpy())
                out.insert(0, "space", space)
                yield out

    schema = "space int, key bigint, " + ", ".join(f"{d} double" for d in dims)
    return points.select(F.col(key).cast("long").alias(key), *features).mapInPandas(run, schema)


def _density_rows(points: DataFrame, key: str, plan: dict[int, Reduction], n_pc: int, eps: Sequence[float], min_pts: Sequence[int]) -> DataFrame:
    """One row per reduction and density setting. Noise counts as a cluster of its own for the silhouette and is left
    out of the index; with fewer than two clusters there is no score."""
    dims, by = [f"pc{j + 1}" for j in range(n_pc)], ["space", "eps", "min_pts"]
    spaces = materialize(_reduced_spaces(points, key, plan, n_pc), "spaces")
    labels = materialize(dbscan_many(spaces, "key", dims, eps, min_pts, "space"), "labels")
    sizes = materialize(scores.balance(labels, "cluster", by), "sizes")
    scored = labels.join(sizes.where("num_clusters >= 2").select(*by), by, "left_semi")
    labelled = materialize(spaces.join(scored, ["space", "key"]), "labelled")
    sil = scores.silhouette_squared(labelled, "cluster", dims, by)
    db = scores.davies_bouldin(labelled, "cluster", dims, by, noise=0)
    names = points.sparkSession.createDataFrame([(i, r.features) for i, r in plan.items()], "space int, features array<string>")
    return sizes.join(sil, by, "left").join(db, by, "left").join(names, "space").select(
        F.lit("DBSCAN").alias("method"), "features", F.lit(n_pc).alias("n_pc"),
        F.create_map(F.lit("eps"), F.col("eps"), F.lit("minPts"), F.col("min_pts").cast("double")).alias("params"),
        "num_clusters", "silhouette", "db_index", "max_min_ratio", "missing_rate",
    )


def rank_configurations(
    results: DataFrame,
    least: int = 2,
    most: int = 4,
    max_ratio: float = 10.0,
    max_missing: float = 0.20,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Finite scores and 2..4 clusters, composite of the rescaled scores, balanced ones, best first.

    Rescaling happens before the balance filter, so it depends on rows that are dropped later.
    The scored rows are few and read twice, so they are written out once.
    """
    clean = results.where(
        is_finite("silhouette") & is_finite("db_index") & F.col("num_clusters").between(least, most)
    )
    clean = materialize(clean, "scored")
    norm = clean.withColumns({"sil_norm": F.col("silhouette"), "dbi_norm": F.col("db_index")})
    norm = rescale(norm, ["sil_norm", "dbi_norm"])
    composite = 0.5 * F.col("sil_norm") + 0.5 * (1 - F.col("dbi_norm"))
    ranked = norm.withColumn("composite", composite).drop("sil_norm", "dbi_norm")
    balanced = ranked.where(
        F.col("max_min_ratio").isNotNull() & (F.col("max_min_ratio") < max_ratio) & (F.col("missing_rate") <= max_missing)
    )
    return balanced.orderBy(F.desc("composite"), *ties)
