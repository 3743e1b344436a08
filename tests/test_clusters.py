import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import components, features, grid, kmeans, pca, scores
from stratapanel.operators.dbscan import dbscan
from stratapanel.operators.ward import ward, ward_cuts


def frame(spark, x, **extra):
    dims = [f"x{i}" for i in range(x.shape[1])]
    names = [*dims, *extra]
    rows = [(i, *map(float, row), *[extra[k][i] for k in extra]) for i, row in enumerate(x)]
    kinds = ", ".join(f"{d} double" for d in dims) + "".join(f", {k} int" for k in extra)
    return spark.createDataFrame(rows, f"id long, {kinds}"), dims, names


def brute_dbscan(x, eps, min_pts):
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = distance <= eps
    core = near.sum(1) >= min_pts
    label = np.full(len(x), -1)
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        todo, label[start] = [start], start
        while todo:
            for other in np.flatnonzero(near[todo.pop()] & core):
                if label[other] < 0:
                    label[other] = start
                    todo.append(other)
    for i in np.flatnonzero(~core):
        owners = label[near[i] & core]
        label[i] = owners.min() if len(owners) else -1
    number = {c: k + 1 for k, c in enumerate(sorted(set(label[label >= 0])))}
    return [number.get(c, 0) for c in label]


def clouds(seed, d, n=220):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 0.25, (n // 2, d)), rng.normal(1.6, 0.3, (n // 3, d)), rng.uniform(-2, 4, (n // 6, d))])
    x[: n // 6] = x[0]  # a third of a cloud are exact copies
    return x[rng.permutation(len(x))].round(2)


@pytest.mark.parametrize("seed, d, eps, min_pts", [(1, 1, 0.02, 3), (2, 2, 0.2, 4), (3, 2, 0.5, 8), (4, 3, 0.45, 5), (5, 4, 0.6, 5), (6, 2, 0.0, 3), (7, 2, 0.12, 2)])
def test_dbscan_matches_brute_force(spark, seed, d, eps, min_pts):
    x = clouds(seed, d)
    df, dims, _ = frame(spark, x)
    got = {r.id: r.cluster for r in dbscan(df, "id", dims, eps, min_pts).collect()}
    assert [got[i] for i in range(len(x))] == brute_dbscan(x, eps, min_pts)


def test_dbscan_joins_dense_cells_by_their_closest_points(spark):
    """Two crowded cells whose boxes neither touch within eps as a whole nor lie apart."""
    left = np.column_stack([np.linspace(0.0, 0.65, 40), np.linspace(0.0, 0.65, 40)])
    for gap, clusters in ((0.9, 1), (1.1, 2)):
        right = np.array([[0.65 + gap, 0.65]] * 40 + [[0.65 + gap + 0.5, 0.0]] * 40)
        x = np.vstack([left, right])
        df, dims, _ = frame(spark, x)
        got = {r.id: r.cluster for r in dbscan(df, "id", dims, 1.0, 30).collect()}
        assert [got[i] for i in range(len(x))] == brute_dbscan(x, 1.0, 30)
        assert len(set(got.values())) == clusters


def test_components_of_a_long_chain(spark):
    nodes = spark.range(70).withColumnRenamed("id", "node")
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = {r.node: r.component for r in components.connected_components(nodes, edges).collect()}
    assert got == {i: 0 if i < 60 else i for i in range(70)}


def brute_silhouette(x, label, power):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) ** power
    out = []
    for i in range(len(x)):
        same = label == label[i]
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, same].sum() / (same.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def brute_db(x, label):
    cs = sorted(set(label))
    centre = {c: x[label == c].mean(0) for c in cs}
    s = {c: np.sqrt(((x[label == c] - centre[c]) ** 2).sum(1).mean()) for c in cs}
    return float(np.mean([max((s[a] + s[b]) / np.linalg.norm(centre[a] - centre[b]) for b in cs if b != a) for a in cs]))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 3))
    label = rng.integers(1, 4, 120)
    x += label[:, None] * 0.8
    label[0] = 9  # a cluster of one
    return x, label


def test_scores_match_brute_force(spark, labelled):
    x, label = labelled
    df, dims, _ = frame(spark, x, l=[int(v) for v in label])
    assert scores.silhouette_squared(df, "l", dims).first()[0] == pytest.approx(brute_silhouette(x, label, 2))
    assert scores.davies_bouldin(df, "l", dims).first()[0] == pytest.approx(brute_db(x, label))
    rest = label != 9
    assert scores.davies_bouldin(df, "l", dims, noise=9).first()[0] == pytest.approx(brute_db(x[rest], label[rest]))


def test_scores_of_many_configurations(spark, labelled):
    x, label = labelled
    df, dims, _ = frame(spark, x, l=[int(v) for v in label])
    both = df.withColumn("config", F.lit("a")).union(df.withColumn("config", F.lit("b")).withColumn("l", F.lit(1)).select(*df.columns, "config"))
    got = {r.config: r.silhouette for r in scores.silhouette_squared(both, "l", dims, ["config"]).collect()}
    assert got["a"] == pytest.approx(brute_silhouette(x, label, 2)) and got["b"] is None
    sizes = {r.config: r for r in scores.balance(both, "l", ["config"], noise=9).collect()}
    assert sizes["a"].num_clusters == 3 and sizes["a"].missing_rate == pytest.approx(1 / 120)
    assert sizes["b"].num_clusters == 1 and sizes["b"].max_min_ratio is None


def test_all_noise_is_balanced_out(spark):
    df = spark.createDataFrame([(0,), (0,), (None,)], "l int")
    row = scores.balance(df, "l").first()
    assert (row.num_clusters, row.max_min_ratio, row.missing_rate) == (0, None, 1.0)


def blobs(seed=0, n=90):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(c, 0.2, (n // 3, 2)) for c in ((0, 0), (4, 0), (0, 5))])


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_planted_clusters_are_found(spark):
    x = blobs()
    truth = np.repeat([0, 1, 2], 30)
    df, dims, _ = frame(spark, x)
    model = kmeans.kmeans_restarts(df, dims, 3)
    for result in (kmeans.assign(df, model, dims), ward(df, dims, 3), ward(df, dims, 3, most=20)):
        got = {r.id: r.cluster for r in result.collect()}
        assert same_partition([got[i] for i in range(90)], truth)
    curve = {r.k: r for r in kmeans.elbow(df, dims, [2, 3, 4]).collect()}
    assert curve[3].wss < curve[2].wss and max(curve, key=lambda k: curve[k].silhouette) == 3


def test_ward_does_not_depend_on_the_files(spark):
    x = np.random.default_rng(4).normal(size=(900, 2)).round(3)
    df, dims, _ = frame(spark, x)
    groups = []
    for n in (1, 3, 7):
        got = {r.id: r.cluster for r in ward(df.repartition(n), dims, 4, most=60).collect()}
        groups.append([got[i] for i in range(900)])
    assert groups[0] == groups[1] == groups[2] and len(set(groups[0])) == 4


def test_points_with_a_missing_coordinate_get_no_cluster(spark):
    df = spark.createDataFrame([(0.0, 1.0), (None, 1.0), (5.0, float("nan"))], "a double, b double")
    assert [r.c for r in df.select(kmeans.nearest_centre(["a", "b"], [[0, 0], [9, 9]]).alias("c")).collect()] == [1, None, None]


def test_ward_merges_least_cost_first():
    x = np.array([[0.0], [0.1], [1.0], [1.3], [9.0]])
    cuts = ward_cuts(x, np.ones(5), [2, 3, 4])
    assert same_partition(cuts[4], [0, 0, 1, 2, 3]) and same_partition(cuts[3], [0, 0, 1, 1, 2])
    assert same_partition(cuts[2], [0, 0, 0, 0, 1])


def test_pca_of_planted_rank_two(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 2))
    x = base @ rng.normal(size=(2, 4)) + rng.normal(scale=0.01, size=(400, 4))
    df, dims, _ = frame(spark, x)
    moments = pca.moments_of(df, dims)
    model = pca.components_of(moments)
    assert model.share[:2].sum() > 0.999 and model.variance.sum() == pytest.approx(4)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = np.array([[r.pc1, r.pc2] for r in pca.scores(df, model, ["id"], 2).orderBy("id").collect()])
    assert np.allclose(got, z @ model.loadings[:, :2])
    assert np.allclose(got.var(axis=0, ddof=1), model.variance[:2])
    sub = pca.components_of(moments.subset(["x1", "x3"]))
    assert np.allclose(sub.variance, np.sort(np.linalg.eigvalsh(np.corrcoef(x[:, [1, 3]].T)))[::-1])
    shares = pca.contributions(spark, model).groupBy("component").agg(F.sum("contribution").alias("c")).collect()
    assert all(r.c == pytest.approx(100) for r in shares)


def test_pca_model_as_a_table(spark):
    df, dims, _ = frame(spark, blobs(5))
    model = pca.components_of(pca.moments_of(df, dims))
    stored = {r.feature: r for r in pca.model_table(spark, model).collect()}
    assert np.allclose(stored["x1"].loadings, model.loadings[1]) and np.allclose(stored["x0"].variance, model.variance)
    assert [r.cumulative for r in pca.summary(spark, model).collect()][-1] == pytest.approx(1.0)


def test_zscore_and_rescale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, c double")
    z = features.zscore(df, ["a", "c"]).agg(F.avg("a").alias("m"), F.stddev_samp("a").alias("s"), F.count("c").alias("c")).first()
    assert z.m == pytest.approx(0, abs=1e-12) and z.s == pytest.approx(1) and z.c == 0
    assert [r.a for r in features.rescale(df, ["a"]).collect()] == [0.0, pytest.approx(0.2), 1.0]


def test_feature_subsets_count(spark):
    names = [f"f{i}" for i in range(9)]
    sets = grid.feature_subsets(spark, names)
    assert sets.count() == 502 and grid.reductions(sets).count() == 1792


def test_grid_search_scores_and_ranking(spark):
    x = np.column_stack([blobs(3), np.random.default_rng(9).normal(size=90)])
    df, dims, _ = frame(spark, x)
    plan = grid.reductions(grid.feature_subsets(spark, dims))
    found = grid.grid_search(df, "id", dims, plan, ks=(2, 3), eps=(0.5,), min_pts=(4,))
    assert found.count() == 5 * (2 * 2 + 1)
    row = found.where("method = 'KMeans' and params['k'] = 3 and array_join(features, ',') = 'x0,x1'").first()
    moments = pca.moments_of(df, dims)
    space = grid.reduced_points(df, "id", moments, ["x0", "x1"], 2).orderBy("id").collect()
    y = np.array([[r.pc1, r.pc2] for r in space])
    truth = np.repeat([0, 1, 2], 30)
    assert row.silhouette == pytest.approx(brute_silhouette(y, truth, 2)) and row.db_index == pytest.approx(brute_db(y, truth))
    best = grid.rank_configurations(found).first()
    assert best.features == ["x0", "x1"] and best.num_clusters == 3


def test_starts_settle_on_a_summary_of_all_rows(spark):
    """The summary keeps counts and means; the best fit is no worse than plain restarts on all rows."""
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.4, (150, 2)) for c in ((0, 0), (2, 1), (1, 3), (4, 3))])
    df, dims, _ = frame(spark, x)
    points, weights = kmeans.weighted_summary(df, dims)
    assert weights.sum() == len(x) and len(weights) <= kmeans.SUMMARY
    assert np.average(points, axis=0, weights=weights) == pytest.approx(x.mean(axis=0))
    centres = kmeans.kmeans_restarts(df, dims, 4)
    cost = lambda c: ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()
    plain = min(cost(kmeans.lloyd(x, np.ones(len(x)), x[rng.permutation(len(x))[:4]])) for _ in range(25))
    assert cost(centres) <= plain * (1 + 1e-6)
    assert kmeans.costs_many(df, dims, {7: centres})[7] == pytest.approx(cost(centres))
    wide = frame(spark, rng.normal(size=(60, 14)))
    assert len(kmeans.weighted_summary(wide[0], wide[1])[1]) == 0 and kmeans.kmeans_restarts(wide[0], wide[1], 2).shape == (2, 14)
