"""Folds, tuned models, nested cross-validation and interpretation on ``pyspark.ml``."""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratapanel.functions.columns import hash_hex
from stratapanel.operators.derive import RAPID, SLOW
from stratapanel.operators.metrics import confusion, f1_accuracy, roc_auc
from stratapanel.operators.ranks import position_by_hash
from stratapanel.session import materialize

MODELS = ("RF", "GBT", "GLMNET")


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Fold 1..k, even within each class, from the hash order of the key."""
    hashed = df.withColumn("__h", hash_hex(key, seed))
    return position_by_hash(hashed, "__h", [label]).withColumn(out, (F.col("position") % k + 1).cast("int")).drop("__h", "position")


def random_baseline(df: DataFrame, key: str, seed: int, out: str = "pred") -> DataFrame:
    """Either class with probability one half, decided by a hash of the key."""
    odd = F.conv(F.substring(hash_hex(key, seed), 1, 1), 16, 10).cast("int") % 2 == 1
    return df.withColumn(out, F.when(odd, F.lit(RAPID)).otherwise(F.lit(SLOW)))


class F1Evaluator(Evaluator):
    """F1 of the positive class, for use wherever ``pyspark.ml`` takes an evaluator."""

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(_class(F.col("y")).alias("truth"), _class(F.col("prediction")).alias("pred"))
        return f1_accuracy(scored).first()["f1"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


def _class(number: Column) -> Column:
    return F.when(number == 1.0, F.lit(RAPID)).otherwise(F.lit(SLOW))


def with_target(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("y", (F.col(label) == RAPID).cast("double"))


#: Ranges of the random search, as whole numbers, numbers, or exponents of ten.
RANGES = {
    "RF": {"numTrees": (100, 500), "maxDepth": (3, 12)},
    "GBT": {"maxIter": (20, 150), "maxDepth": (1, 6), "stepSize": (0.01, 0.4), "subsamplingRate": (0.5, 1.0)},
    "GLMNET": {"elasticNetParam": (0.0, 1.0), "regParam": (-4.0, 0.0)},
}


def draw_parameters(model: str, n_features: int, draws: int, seed: int, ranges: dict | None = None) -> list[dict]:
    """Random search: parameter sets drawn from ``ranges`` (``RANGES``), the same for the same seed."""
    rng = random.Random(f"{model}-{seed}")
    sets = []
    for _ in range(draws):
        drawn = {name: rng.randint(*span) if isinstance(span[0], int) else rng.uniform(*span) for name, span in (ranges or RANGES)[model].items()}
        if model == "RF":
            drawn["featureSubsetStrategy"] = str(rng.randint(1, n_features))
        if "regParam" in drawn:
            drawn["regParam"] = 10 ** drawn["regParam"]
        sets.append(drawn)
    return sets


def staged_model(model: str, features: Sequence[str], params: dict, seed: int = 123) -> Pipeline:
    """Scaling is a stage of the model, so it is fitted on training rows only.

    Trees get features rescaled to [0, 1], the linear model centred and scaled ones.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="raw")
    if model == "GLMNET":
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
        learner = LogisticRegression(labelCol="y", standardization=False, maxIter=100, **params)
    else:
        scaler = MinMaxScaler(inputCol="raw", outputCol="features")
        kind = RandomForestClassifier if model == "RF" else GBTClassifier
        learner = kind(labelCol="y", seed=seed, **params)
    return Pipeline(stages=[assembler, scaler, learner])


def predictions(fitted: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``truth``, ``pred`` and the probability of the positive class, next to the kept columns."""
    scored = fitted.transform(df)
    return scored.select(
        *keep,
        _class(F.col("y")).alias("truth"),
        _class(F.col("prediction")).alias("pred"),
        vector_to_array("probability")[1].alias("prob"),
    )


@dataclass
class Tuning:
    """How far to search; the defaults are the full study, small values make a quick run."""

    draws: int = 30
    folds: int = 5
    repeats: int = 10
    seed: int = 123
    parallel: int = 4
    models: Sequence[str] = field(default_factory=lambda: MODELS)


def tune(df: DataFrame, model: str, features: Sequence[str], key: str, tuning: Tuning) -> tuple[dict, DataFrame]:
    """Best parameters by mean F1 over repeated stratified folds, and the score of every draw.

    Fits run a few at a time from driver threads; each is itself a distributed job. The resamples
    are scored together in one aggregation per draw.
    """
    spark = df.sparkSession
    sets = draw_parameters(model, len(features), tuning.draws, tuning.seed)
    schema = "model string, draw int, params string, f1 double"
    base = with_target(df)
    for r in range(tuning.repeats):
        base = stratified_folds(base, key, "label", tuning.folds, tuning.seed + 1000 * (r + 1), f"fold{r}")
    base = materialize(base, "folds", rebalance=True)

    def score(draw: int) -> tuple[int, float]:
        parts = None
        for r in range(tuning.repeats):
            for f in range(1, tuning.folds + 1):
                train, test = base.where(F.col(f"fold{r}") != f), base.where(F.col(f"fold{r}") == f)
                fitted = staged_model(model, features, sets[draw], tuning.seed).fit(train)
                part = confusion(predictions(fitted, test, [])).withColumn("resample", F.lit(r * tuning.folds + f))
                parts = part if parts is None else parts.unionByName(part)
        f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
        return draw, parts.agg(F.avg(F.coalesce(f1, F.lit(0.0)))).first()[0]

    with ThreadPoolExecutor(tuning.parallel) as pool:
        scored = dict(pool.map(score, range(len(sets))))
    best = max(scored, key=lambda i: (scored[i], -i))
    table = [(model, i, str(sets[i]), float(scored[i])) for i in sorted(scored)]
    return sets[best], spark.createDataFrame(table, schema)


def refit(df: DataFrame, model: str, features: Sequence[str], key: str, tuning: Tuning) -> tuple[dict, PipelineModel]:
    """Tune on all rows and fit the best parameters to all rows."""
    best, _ = tune(df, model, features, key, tuning)
    rows = materialize(with_target(df), "refit", rebalance=True)
    return best, staged_model(model, features, best, tuning.seed).fit(rows)


def nested_predictions(df: DataFrame, features: Sequence[str], key: str, tuning: Tuning, outer: int = 5) -> DataFrame:
    """Out-of-fold predictions ``(fold, model, key, truth, pred, prob)`` of tuned models and of the
    random baseline."""
    folded = materialize(with_target(stratified_folds(df, key, "label", outer, tuning.seed)), "folds", rebalance=True)
    baseline = random_baseline(folded, key, tuning.seed).select(
        "fold", F.lit("RandomBaseline").alias("model"), key, F.col("label").alias("truth"), "pred", F.lit(None).cast("double").alias("prob")
    )
    parts = [baseline]
    for fold in range(1, outer + 1):
        train, test = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        for model in tuning.models:
            best, _ = tune(train.drop("y", "fold"), model, features, key, tuning)
            fitted = staged_model(model, features, best, tuning.seed).fit(train)
            scored = predictions(fitted, test, ["fold", key])
            parts.append(scored.select("fold", F.lit(model).alias("model"), key, "truth", "pred", "prob"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def fold_results(out_of_fold: DataFrame) -> DataFrame:
    """F1, accuracy, sensitivity, specificity and AUC for every fold and model."""
    by = ["fold", "model"]
    rates = confusion(out_of_fold, by).select(*by, "sensitivity", "specificity")
    auc = roc_auc(out_of_fold.where(F.col("prob").isNotNull()), "prob", by, direction="auto")
    return f1_accuracy(out_of_fold, by).join(rates, by).join(auc, by, "left")


def coefficients(spark: SparkSession, fitted: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Coefficient, odds ratio, direction and importance (absolute values from the smallest, 0, to the largest, 100)."""
    values = [float(v) for v in fitted.stages[-1].coefficients]
    rows = spark.createDataFrame(list(zip(features, values)), "feature string, estimate double")
    sizes = [abs(v) for v in values] or [0.0]
    least, span = min(sizes), max(sizes) - min(sizes)
    return rows.select(
        "feature",
        "estimate",
        F.exp("estimate").alias("odds_ratio"),
        F.when(F.col("estimate") > 0, F.lit(f"↑ {RAPID}")).otherwise(F.lit(f"↑ {SLOW}")).alias("direction"),
        ((F.abs("estimate") - least) * (100.0 / span if span else 0.0)).alias("importance"),
    )


def top(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(F.abs(column)), tie).limit(n)


def linear_probability(weights: dict[str, float], intercept: float) -> Column:
    terms = [F.col(name) * F.lit(float(w)) for name, w in weights.items()]
    return 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) + F.lit(float(intercept)))))


def partial_dependence(df: DataFrame, feature: str, grid: Sequence[float], probability) -> DataFrame:
    """Mean predicted probability with ``feature`` set to each grid value for every row.

    ``probability`` maps a frame to one with a ``prob`` column. The grid is a short list, so the
    rows are expanded in place and averaged before any shuffle.
    """
    expanded = df.withColumn(feature, F.explode(F.array(*[F.lit(float(v)) for v in grid])))
    return probability(expanded).groupBy(F.col(feature).alias("value")).agg(F.avg("prob").alias("mean_prob"))


def grid_values(df: DataFrame, feature: str, points: int = 20) -> list[float]:
    low, high = df.agg(F.min(feature), F.max(feature)).first()
    return [low + (high - low) * i / (points - 1) for i in range(points)]
