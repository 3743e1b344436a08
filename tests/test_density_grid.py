import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import grid, pca
from stratapanel.operators.dbscan import dbscan
from stratapanel.operators.density_grid import dbscan_many
from test_clusters import brute_db, brute_dbscan, brute_silhouette, clouds, frame


def by_setting(rows, n):
    out = {}
    for r in rows:
        out.setdefault((r.eps, r.min_pts), [None] * n)[r.id] = r.cluster
    return out


@pytest.mark.parametrize("seed, d", [(1, 1), (2, 2), (3, 3), (4, 4)])
def test_every_setting_equals_brute_force(spark, seed, d):
    x = clouds(seed, d, 150)
    df, dims, _ = frame(spark, x)
    eps, min_pts = (0.0, 0.1, 0.3, 0.5, 0.9, 2.0), (1, 2, 4, 8, 40)
    found = by_setting(dbscan_many(df, "id", dims, eps, min_pts).collect(), len(x))
    assert set(found) == {(e, m) for e in eps for m in min_pts}
    for (e, m), labels in found.items():
        assert labels == brute_dbscan(x, e, m), (e, m)


def test_full_width_equals_one_run_a_setting(spark):
    x = clouds(5, 2, 120)
    df, dims, _ = frame(spark, x)
    eps, min_pts = [round(0.2 * k, 1) for k in range(11)], range(2, 9)
    found = by_setting(dbscan_many(df, "id", dims, eps, min_pts).collect(), len(x))
    assert len(found) == 77
    for e, m in ((0.0, 2), (0.2, 2), (0.2, 8), (0.6, 5), (2.0, 8)):
        assert found[e, m] == [r.cluster for r in dbscan(df, "id", dims, e, m).orderBy("id").collect()]
    assert all(labels == brute_dbscan(x, *setting) for setting, labels in found.items())


def test_crowded_cells_that_only_their_closest_points_join(spark):
    """Boxes that neither touch within the radius as a whole nor lie apart, told apart for every count."""
    left = np.column_stack([np.linspace(0.0, 0.65, 40), np.linspace(0.0, 0.65, 40)])
    right = np.array([[1.6, 0.65]] * 40 + [[2.1, 0.0]] * 40)
    x = np.vstack([left, right])
    df, dims, _ = frame(spark, x)
    for (e, m), labels in by_setting(dbscan_many(df, "id", dims, (0.9, 0.94, 0.96, 1.1), (2, 20)).collect(), len(x)).items():
        assert labels == brute_dbscan(x, e, m), (e, m)


def test_spaces_do_not_mix_and_missing_points_are_left_out(spark):
    one, two = clouds(6, 2, 100), clouds(7, 2, 100)
    parts = [frame(spark, x)[0].withColumn("space", F.lit(k)) for k, x in enumerate((one, two))]
    df = parts[0].unionByName(parts[1]).unionByName(spark.sql("select 900L as id, double(null) as x0, 1d as x1, 0 as space"))
    rows = dbscan_many(df, "id", ["x0", "x1"], (0.0, 0.3), (3,), space="space").collect()
    assert len(rows) == 2 * (len(one) + len(two)) and all(r.id != 900 for r in rows)
    for k, x in enumerate((one, two)):
        for setting, labels in by_setting([r for r in rows if r.space == k], len(x)).items():
            assert labels == brute_dbscan(x, *setting)


def test_no_points(spark):
    df, dims, _ = frame(spark, clouds(8, 2, 60))
    assert dbscan_many(df.where("false"), "id", dims, (0.0, 0.3), (3, 5)).count() == 0


def test_search_scores_all_settings_of_several_reductions(spark):
    x = np.column_stack([clouds(9, 2, 90), np.random.default_rng(9).normal(size=len(clouds(9, 2, 90)))])
    df, dims, _ = frame(spark, x)
    plan = grid.reductions(grid.feature_subsets(spark, dims))
    eps, min_pts = [round(0.2 * k, 1) for k in range(11)], range(2, 9)
    found = grid.grid_search(df, "id", dims, plan, ks=(), eps=eps, min_pts=min_pts).collect()
    assert len(found) == 77 * 5  # three pairs and one triple of features to two components, the triple to three
    moments, scored = pca.moments_of(df, dims), 0
    for chosen, n_pc in ((["x0", "x1"], 2), (["x0", "x1", "x2"], 3)):
        space = grid.reduced_points(df, "id", moments, chosen, n_pc).orderBy("id").collect()
        y = np.array([[r[f"pc{k + 1}"] for k in range(n_pc)] for r in space])
        for row in found:
            if row.features != chosen or row.n_pc != n_pc:
                continue
            labels = np.array(brute_dbscan(y, row.params["eps"], row.params["minPts"]))
            assert row.num_clusters == labels.max() and row.missing_rate == pytest.approx((labels == 0).mean())
            if row.num_clusters < 2:
                assert row.silhouette is None and row.db_index is None
                continue
            scored += 1
            assert row.silhouette == pytest.approx(brute_silhouette(y, labels, 2)), row.params
            assert row.db_index == pytest.approx(brute_db(y[labels > 0], labels[labels > 0])), row.params
    assert scored > 20


def test_scores_of_many_clusters_are_those_of_few_walked_row_by_row(spark, monkeypatch):
    """Above SHORT clusters the points are dealt into parts; both ways give the brute-force scores."""
    from stratapanel.operators import scores

    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 2))
    many, few = rng.integers(0, 90, 240), rng.integers(0, 3, 240)
    rows = [("many", float(a), float(b), int(c)) for (a, b), c in zip(x, many)] + [("few", float(a), float(b), int(c)) for (a, b), c in zip(x, few)]
    df = spark.createDataFrame(rows, "config string, a double, b double, l int")
    monkeypatch.setattr(scores, "PART", 50)
    calls = []
    dealt = scores._dealt
    monkeypatch.setattr(scores, "_dealt", lambda *args: calls.append(1) or dealt(*args))
    sil = {r.config: r.silhouette for r in scores.silhouette_squared(df, "l", ["a", "b"], ["config"]).collect()}
    db = {r.config: r.db_index for r in scores.davies_bouldin(df, "l", ["a", "b"], ["config"]).collect()}
    assert len(calls) == 2
    for name, label in (("many", many), ("few", few)):
        assert sil[name] == pytest.approx(brute_silhouette(x, label, 2)) and db[name] == pytest.approx(brute_db(x, label))
