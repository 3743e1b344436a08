import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from stratapanel.operators import ranks
from stratapanel.operators.inference import signed_rank
from stratapanel.operators.metrics import roc_auc
from stratapanel.operators.quantiles import exact_quantiles

VALUES = st.lists(st.sampled_from([0.0, -1.5, 2.0, 2.5, 7.0, 7.25, 1e6, -3e5]) | st.floats(-100, 100), min_size=1, max_size=60)


def average_rank(values):
    order = np.sort(values)
    return {v: (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2 for v in values}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=VALUES)
def test_ranks_and_quantiles_match_numpy(spark, tiny_buckets, values):
    values = [v + 0.0 for v in values]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.x: r["rank"] for r in ranks.average_ranks(df, "x").collect()}
    assert got == average_rank(values)
    probs = [0.0, 0.2, 0.25, 0.5, 0.77, 1.0]
    assert np.allclose(list(exact_quantiles(df, "x", probs).first()), np.quantile(values, probs), rtol=1e-12)


def test_hot_group_and_hot_value(spark, tiny_buckets):
    rng = np.random.default_rng(3)
    rows = [("hot", 5.0)] * 300 + [("hot", float(v)) for v in rng.normal(size=200)] + [("cold", 1.0), ("cold", 2.0), (None, 3.0), ("void", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: (r.q0, r.q1) for r in exact_quantiles(df, "x", [0.5, 0.9], ["g"]).collect()}
    hot = [x for g, x in rows if g == "hot"]
    assert got["hot"] == pytest.approx(tuple(np.quantile(hot, [0.5, 0.9])))
    assert got["cold"] == pytest.approx((1.5, 1.9)) and got[None] == (3.0, 3.0) and "void" not in got


def test_positions_are_a_permutation_per_class(spark):
    df = spark.range(2000).withColumn("c", F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 10 < 9, "a")).withColumn("h", F.md5(F.col("id").cast("string")))
    rows = ranks.position_by_hash(df, "h", ["c"]).collect()
    assert len(rows) == 2000
    for c in ("a", "b", None):
        mine = sorted((r.h, r.position) for r in rows if r.c == c)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_auc_matches_pairs(spark, tiny_buckets):
    rng = np.random.default_rng(5)
    rows = [(("Rapid_growth" if rng.random() < 0.4 else "Slow_growth"), float(rng.integers(0, 30))) for _ in range(200)]
    pos, neg = [s for t, s in rows if t == "Rapid_growth"], [s for t, s in rows if t != "Rapid_growth"]
    expected = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    df = spark.createDataFrame(rows, "truth string, s double")
    assert roc_auc(df, "s").first()[0] == pytest.approx(expected)
    turned = roc_auc(df.withColumn("s", -F.col("s")), "s", direction="auto").first()[0]
    assert turned == pytest.approx(max(expected, 1 - expected))


def test_signed_rank_with_ties_and_zeros(spark, tiny_buckets):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    b = [1.0, 1.0, 4.0, 2.0, 3.0, 8.0, 4.0, 3.0]
    d = [x - y for x, y in zip(a, b) if x != y]
    rank = average_rank([abs(v) for v in d])
    v = sum(rank[abs(x)] for x in d if x > 0)
    got = signed_rank(spark.createDataFrame(list(zip(a, b)), "a double, b double"), "a", "b").first()
    n = len(d)
    ties = sum(c**3 - c for c in np.unique(np.abs(d), return_counts=True)[1])
    z = (v - n * (n + 1) / 4 - 0.5) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert (got.v, got.n_pairs) == (v, n) and got.z == pytest.approx(z)


def test_bucket_of_long_lists_of_cuts(spark, monkeypatch):
    monkeypatch.setattr(ranks, "STRETCH", 4)
    rng = np.random.default_rng(7)
    values = rng.integers(0, 40, 200).astype(float)
    for n in (3, 4, 5, 8, 15, 30):
        cuts = sorted(set(rng.choice(40, n, replace=False).astype(float)))
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = [r[0] for r in df.select(ranks.bucket_of(F.col("x"), cuts)).collect()]
        assert got == [int(np.searchsorted(cuts, v, "left")) for v in values]
