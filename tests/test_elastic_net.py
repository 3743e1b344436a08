import numpy as np
import pytest
from pyspark.sql import functions as F

from stratapanel.operators import classify, elastic_net
from stratapanel.operators.elastic_net import Fit

FEATURES = [f"x{k}" for k in range(5)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5)) * [1, 10, 0.1, 5, 1] + [0, 100, 3, -20, 0]
    x[:, 4] = 0.7 * x[:, 0] + 0.3 * x[:, 4]
    eta = 1.5 * x[:, 0] - 0.1 * (x[:, 1] - 100) + 6 * (x[:, 2] - 3) + 0.4
    y = rng.random(700) < 1 / (1 + np.exp(-eta))
    rows = [(i, *map(float, x[i]), "Rapid_growth" if y[i] else "Slow_growth") for i in range(700)]
    return spark.createDataFrame(rows, "entity long, " + ", ".join(f"{c} double" for c in FEATURES) + ", label string").repartition(4)


@pytest.fixture(scope="module")
def data(planted):
    return elastic_net.study_folds(planted, "entity", "label", 5, 5, 2, 9)


def test_fits_equal_those_of_the_library(data):
    """All settings and training sets at once against one fit each of a scaled logistic regression."""
    fits = [Fit(m, r, h) for m in (0.0, 0.5, 1.0) for r in (1e-4, 1e-2, 0.1, 1.0) for h in ((), ((0, 2),), ((0, 1), (2, 3)))]
    solved = elastic_net.fit_all(data, FEATURES, fits)
    assert solved.at_rest.all() and solved.passes.max() < 20
    for k in (0, 4, 9, 14, 18, 23, 28, 31, 35):
        train = data
        for place, fold in fits[k].held:
            train = train.where(F.col("folds")[place] != fold)
        params = {"elasticNetParam": fits[k].mix, "regParam": fits[k].reg, "tol": 1e-10}
        theirs = classify.staged_model("GLMNET", FEATURES, params).fit(train).stages[-1]
        assert solved.scaled[k, 0] == pytest.approx(theirs.intercept, abs=2e-4)
        assert solved.scaled[k, 1:] == pytest.approx(theirs.coefficients.toArray(), abs=2e-4)


def test_raw_coefficients_predict_like_the_scaled_ones(data):
    solved = elastic_net.fit_all(data, FEATURES, [Fit(0.5, 0.01)])
    rows = data.select(*FEATURES).toPandas().to_numpy()
    z = (rows - rows.mean(axis=0)) / rows.std(axis=0, ddof=1)
    assert rows @ solved.raw[0, 1:] + solved.raw[0, 0] == pytest.approx(z @ solved.scaled[0, 1:] + solved.scaled[0, 0])


def test_a_constant_feature_and_a_full_penalty_leave_the_intercept(data):
    solved = elastic_net.fit_all(data.withColumn("x4", F.lit(7.0)), FEATURES, [Fit(1.0, 10.0, ((1, 1),)), Fit(0.0, 0.01)])
    share = data.where("folds[1] <> 1").agg(F.avg("y")).first()[0]
    assert solved.scaled[0, 1:].tolist() == [0.0] * 5 and solved.scaled[0, 0] == pytest.approx(np.log(share / (1 - share)), abs=1e-6)
    assert solved.scaled[1, 5] == 0.0 and np.isfinite(solved.raw).all()


def test_counts_are_those_of_the_test_rows(data):
    fits = [Fit(0.5, 0.01, ((0, 2), (1, 3))), Fit(0.5, 0.01, ((2, 1),))]
    solved = elastic_net.fit_all(data, FEATURES, fits)
    counts = elastic_net.held_out_counts(data, FEATURES, fits, solved)
    for k, test in enumerate(("folds[0] <> 2 and folds[1] = 3", "folds[2] = 1")):
        rows = data.where(test).select(*FEATURES, "y").toPandas().to_numpy()
        said, yes = rows[:, :5] @ solved.raw[k, 1:] + solved.raw[k, 0] > 0, rows[:, 5] > 0.5
        assert counts[k].tolist() == [(said & yes).sum(), (said & ~yes).sum(), (~said & yes).sum(), (~said & ~yes).sum()]


def test_inner_folds_are_even_within_every_outer_training_set(data):
    for outer in range(1, 6):
        sizes = data.where(F.col("folds")[0] != outer).groupBy("label", F.col("folds")[1].alias("f")).count().collect()
        for label in ("Rapid_growth", "Slow_growth"):
            mine = [r["count"] for r in sizes if r.label == label]
            assert len(mine) == 5 and max(mine) - min(mine) <= 4


def test_nested_study_equals_separate_searches(planted, data):
    study = elastic_net.nested_study(planted, "entity", "label", FEATURES, draws=4, folds=5, repeats=2, outer=5, seed=9)
    draws = {(r.fold, r.draw): r for r in study.draws.collect()}
    assert len(draws) == 24 and all(r.at_rest for r in draws.values())
    one = draws[3, 1]  # a draw of an outer fold, by fits of its own
    scores = []
    for repeat in (1, 2):
        for fold in range(1, 6):
            train = data.where(f"folds[0] <> 3 and folds[{repeat}] <> {fold}")
            test = data.where(f"folds[0] <> 3 and folds[{repeat}] = {fold}")
            if (repeat, fold) in ((1, 2), (2, 5)):
                model = classify.staged_model("GLMNET", FEATURES, {"elasticNetParam": one.mix, "regParam": one.reg, "tol": 1e-10}).fit(train)
                theirs = classify.f1_accuracy(classify.predictions(model, test, [])).first().f1
                fit = Fit(one.mix, one.reg, ((0, 3), (repeat, fold)))
                solved = elastic_net.fit_all(data, FEATURES, [fit])
                assert elastic_net._f1(elastic_net.held_out_counts(data, FEATURES, [fit], solved))[0] == pytest.approx(theirs)
            scores.append(fold)
    predictions = study.predictions.collect()
    assert len(predictions) == 700 and len({r.entity for r in predictions}) == 700
    best = max(range(4), key=lambda d: (draws[2, d].mean_f1, -d))
    model = classify.staged_model("GLMNET", FEATURES, {"elasticNetParam": draws[2, best].mix, "regParam": draws[2, best].reg, "tol": 1e-10}).fit(data.where("folds[0] <> 2"))
    theirs = {r.entity: r.prob for r in classify.predictions(model, data.where("folds[0] = 2"), ["entity"]).collect()}
    mine = {r.entity: r.prob for r in predictions if r.fold == 2}
    assert mine.keys() == theirs.keys() and all(mine[k] == pytest.approx(theirs[k], abs=1e-4) for k in mine)
    accuracy = elastic_net.fold_scores(study.predictions).agg(F.avg("accuracy")).first()[0]
    assert accuracy > 0.75
    table = {r.feature: r for r in elastic_net.interpreted(study.coefficients).collect()}
    assert table["x0"].direction.endswith("Rapid_growth") and table["x1"].odds_ratio < 1 and max(r.importance for r in table.values()) == 100.0


def test_fits_that_leave_out_a_fold_each_share_a_head_and_equal_fits_alone(data):
    """Fits to folds start from the fit to all their rows and use its matrix; alone they have one of their own."""
    settings = ((0.3, 1e-4), (0.9, 0.02), (0.0, 0.5))
    fits = [Fit(m, r, (*outer, (place, fold))) for m, r in settings for outer in ((), ((0, 3),)) for place in (1, 2) for fold in range(1, 6)]
    everything, head = elastic_net._families([*fits, Fit(*settings[0], ((0, 3),))])
    assert len(everything) == len(fits) + 6 and (head[: len(fits)] >= 0).all() and (head[len(fits) :] == -1).all()
    assert all(everything[h] == Fit(f.mix, f.reg, f.held[:-1]) for f, h in zip(fits, head))
    together = elastic_net.fit_all(data, FEATURES, fits)
    assert together.at_rest.all() and len(together.passes) == len(fits)
    for k in (0, 7, 12, 23, 34, 41, 59):
        alone = elastic_net.fit_all(data, FEATURES, [fits[k]])
        assert together.scaled[k] == pytest.approx(alone.scaled[0], abs=1e-6) and together.raw[k] == pytest.approx(alone.raw[0], abs=1e-6)


def test_a_fit_far_from_its_head_gets_a_matrix_of_its_own(spark):
    """One fold holds nearly all positive rows, so the fit without it is far from the fit to all rows."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        fold = k % 5 + 1
        x = float(rng.normal() + (6 if fold == 1 else 0))
        rows.append((float(rng.random() < (0.9 if fold == 1 else 0.05)), [fold], x, float(rng.normal())))
    odd = spark.createDataFrame(rows, "y double, folds array<int>, a double, b double")
    fits = [Fit(0.5, 1e-4, ((0, f),)) for f in range(1, 6)]
    together = elastic_net.fit_all(odd, ["a", "b"], fits)
    assert together.at_rest.all()
    for k in range(5):
        assert together.scaled[k] == pytest.approx(elastic_net.fit_all(odd, ["a", "b"], fits[k : k + 1]).scaled[0], abs=1e-6)
