import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stratapanel.operators import classify, metrics
from stratapanel.sources.catalog import save_model

BETA = {"x0": 2.0, "x1": -1.5, "x2": 0.0}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    p = 1 / (1 + np.exp(-(x @ np.array(list(BETA.values())) + 0.3)))
    rows = [(i, *map(float, x[i]), "Rapid_growth" if rng.random() < p[i] else "Slow_growth") for i in range(600)]
    return spark.createDataFrame(rows, "entity long, x0 double, x1 double, x2 double, label string").repartition(3)


def test_folds_are_stratified_and_stable(planted):
    folds = classify.stratified_folds(planted, "entity", "label", 5, 1)
    sizes = folds.groupBy("label", "fold").count().collect()
    for label in ("Rapid_growth", "Slow_growth"):
        mine = [r["count"] for r in sizes if r.label == label]
        assert len(mine) == 5 and max(mine) - min(mine) <= 1
    again = classify.stratified_folds(planted.repartition(7), "entity", "label", 5, 1)
    assert {(r.entity, r.fold) for r in folds.collect()} == {(r.entity, r.fold) for r in again.collect()}


def test_baseline_is_about_even(planted):
    share = classify.random_baseline(planted, "entity", 3).agg(F.avg((F.col("pred") == "Rapid_growth").cast("int"))).first()[0]
    assert 0.4 < share < 0.6


def test_f1_is_symmetric_and_null_without_positives(spark):
    rows = [("Rapid_growth", "Slow_growth"), ("Rapid_growth", "Rapid_growth"), ("Slow_growth", "Rapid_growth"), ("Slow_growth", "Slow_growth"), ("Slow_growth", "Slow_growth")]
    df = spark.createDataFrame(rows, "truth string, pred string")
    one = metrics.f1_accuracy(df).first()
    two = metrics.f1_accuracy(df, truth="pred", pred="truth").first()
    assert one == two and one.f1 == pytest.approx(0.5) and one.accuracy == pytest.approx(0.6)
    none = metrics.f1_accuracy(df.where("truth = 'Slow_growth' and pred = 'Slow_growth'")).first()
    assert none.f1 is None and none.accuracy == 1.0


def test_elastic_net_recovers_planted_coefficients(spark, planted, tmp_path):
    fitted = classify.staged_model("GLMNET", list(BETA), {"elasticNetParam": 0.5, "regParam": 0.001}).fit(classify.with_target(planted))
    got = {r.feature: r for r in classify.coefficients(spark, fitted, list(BETA)).collect()}
    assert got["x0"].estimate == pytest.approx(2.0, abs=0.4) and got["x1"].estimate == pytest.approx(-1.5, abs=0.4)
    assert got["x0"].odds_ratio == pytest.approx(math.exp(got["x0"].estimate))
    assert got["x0"].importance == 100.0 and min(r.importance for r in got.values()) == 0.0 and got["x1"].direction == "↑ Slow_growth"
    top = classify.top(classify.coefficients(spark, fitted, list(BETA)), "estimate", 2, "feature").collect()
    assert [r.feature for r in top] == ["x0", "x1"]
    save_model(fitted, str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert list(loaded.stages[-1].coefficients) == list(fitted.stages[-1].coefficients)


def test_scaling_is_fitted_on_training_rows_only(planted):
    train, test = classify.with_target(planted).where("entity < 300"), classify.with_target(planted).where("entity >= 300")
    fitted = classify.staged_model("RF", list(BETA), {"numTrees": 3}).fit(train)
    low = train.agg(F.min("x0")).first()[0]
    assert fitted.stages[1].originalMin[0] == pytest.approx(low)
    assert classify.predictions(fitted, test, ["entity"]).count() == test.count()


def test_tuning_and_nested_results(spark, planted):
    tuning = classify.Tuning(draws=2, folds=2, repeats=1, models=("GLMNET",))
    best, table = classify.tune(planted, "GLMNET", list(BETA), "entity", tuning)
    scores = {r.draw: r.f1 for r in table.collect()}
    _, one = classify.tune(planted, "GLMNET", list(BETA), "entity", classify.Tuning(draws=1, folds=2, repeats=1))
    assert all(r.f1 is not None and r.f1 > 0.5 for r in one.collect())
    assert len(scores) == 2 and str(best) == table.orderBy(F.desc("f1"), "draw").first().params
    again, fitted = classify.refit(planted, "GLMNET", list(BETA), "entity", tuning)
    assert again == best and fitted.stages[-1].numFeatures == 3
    assert classify.draw_parameters("RF", 3, 5, 1) == classify.draw_parameters("RF", 3, 5, 1)
    out = classify.nested_predictions(planted, list(BETA), "entity", classify.Tuning(draws=1, folds=2, repeats=1, models=("GLMNET",)), outer=3)
    assert out.groupBy("model").count().where("count <> 600").isEmpty()
    summary = {r.model: r for r in metrics.fold_summary(classify.fold_results(out), ["f1", "auc"]).collect()}
    assert summary["GLMNET"].mean_f1 > 0.75 > summary["RandomBaseline"].mean_f1
    assert summary["GLMNET"].mean_auc > 0.85 and summary["RandomBaseline"].mean_auc is None
    assert classify.F1Evaluator().isLargerBetter()
    wide_ci = summary["GLMNET"]
    assert wide_ci.ci_f1_l < wide_ci.mean_f1 < wide_ci.ci_f1_u


def test_partial_dependence_of_a_linear_score(planted):
    probability = lambda d: d.withColumn("prob", classify.linear_probability({"x0": 1.0, "x1": 0.5}, 0.0))
    got = {r.value: r.mean_prob for r in classify.partial_dependence(planted, "x0", [-1, 0, 1], probability).collect()}
    x1 = np.array([r.x1 for r in planted.select("x1").collect()])
    for v in (-1, 0, 1):
        assert got[v] == pytest.approx(np.mean(1 / (1 + np.exp(-(v + 0.5 * x1)))))
    grid = classify.grid_values(planted, "x0", 5)
    assert len(grid) == 5 and grid == sorted(grid)


def test_queries_of_untuned_models_are_not_registered():
    from stratapanel import plans
    from stratapanel.plans.registry import QUERIES

    assert plans and not {"importance_odds", "partial_dependence_model", "model_comparison", "misclassification_map"} & set(QUERIES)


def test_error_rates_and_model_differences(spark):
    rows = [(f, m, g, "Rapid_growth", "Rapid_growth" if hit else "Slow_growth") for f, m, g, hit in [(1, "A", "x", 1), (1, "A", "x", 0), (1, "A", "y", 1), (2, "B", "y", 1)]]
    wrong = {r.g: r.mis_rate for r in metrics.error_rates(spark.createDataFrame(rows, "fold int, model string, g string, truth string, pred string"), "g").collect()}
    assert wrong == {"x": 0.5, "y": 0.0}
    scores = [(f, m, 0.1 * f + (0.05 * f if m == "A" else 0)) for f in range(1, 6) for m in "AB"]
    (found,) = metrics.compare_models(spark.createDataFrame(scores, "fold int, model string, f1 double"), "f1", [("A", "B")]).collect()
    assert found.comparison == "A vs B" and abs(found.mean_diff - 0.15) < 1e-9 and abs(found.p_value - 0.0590585) < 1e-4
