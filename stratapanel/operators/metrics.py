"""Classification metrics by conditional counts; all work per group (fold, model) in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stratapanel.functions.distributions import t_critical
from stratapanel.operators.derive import RAPID
from stratapanel.operators.inference import signed_rank
from stratapanel.operators.ranks import running_counts
from stratapanel.operators.reshape import to_wide


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def confusion(df: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred", positive: str = RAPID) -> DataFrame:
    t, p = F.col(truth) == positive, F.col(pred) == positive
    counts = df.groupBy(*by).agg(
        _count(t & p).alias("tp"), _count(~t & p).alias("fp"), _count(t & ~p).alias("fn"), _count(~t & ~p).alias("tn")
    )
    return counts.withColumns(
        {
            "sensitivity": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "specificity": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")),
        }
    )


def f1_accuracy(df: DataFrame, by: Sequence[str] = (), truth: str = "truth", pred: str = "pred", positive: str = RAPID) -> DataFrame:
    c = confusion(df, by, truth, pred, positive)
    return c.select(
        *by,
        F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"),
    )


def roc_auc(
    df: DataFrame, score: str, by: Sequence[str] = (), truth: str = "truth", positive: str = RAPID, direction: str = "high"
) -> DataFrame:
    """Area under the ROC curve with ties counted half, from counts per distinct score.

    ``direction="auto"`` turns the score round where that gives more than one half.
    """
    yes = (F.col(truth) == positive).cast("long")
    ranked = running_counts(df.where(F.col(truth).isNotNull()), score, {"pos": yes, "neg": 1 - yes}, by)
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    result = ranked.groupBy(*by).agg(F.sum(wins).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    auc = F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n"))
    if direction == "auto":
        auc = F.greatest(auc, 1 - auc)
    return result.select(*by, auc.alias("auc"))


def error_rates(df: DataFrame, key: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(key).agg(F.avg((F.col(truth) != F.col(pred)).cast("double")).alias("mis_rate"))


def fold_summary(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model",), level: float = 0.95) -> DataFrame:
    """Mean, deviation and t interval of each metric over folds, by model.

    The degrees of freedom count all folds, as the number of folds is fixed by design.
    """
    base = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        *[f(m).alias(f"{name}_{m}") for m in metrics for name, f in (("mean", F.avg), ("sd", F.stddev_samp))],
    )
    base = base.withColumn("__t", t_critical(F.lit((1 + level) / 2), (F.col("__n") - 1).cast("double")))
    out = []
    for m in metrics:
        half = F.col("__t") * F.col(f"sd_{m}") / F.sqrt("__n")
        mean = F.col(f"mean_{m}")
        out += [mean, F.col(f"sd_{m}"), (mean - half).alias(f"ci_{m}_l"), (mean + half).alias(f"ci_{m}_u")]
    return base.select(*by, *out)


def compare_models(results: DataFrame, metric: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean difference and signed-rank p-value over folds for each pair of models, in one job."""
    names = sorted({name for pair in pairs for name in pair})
    wide = to_wide(results.where(F.col("model").isin(names)), ["fold"], "model", names, metric)
    entries = [
        F.struct(F.lit(f"{a} vs {b}").alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs
    ]
    rows = wide.select(F.inline(F.array(*entries)))
    means = rows.groupBy("comparison").agg(F.avg(F.col("a") - F.col("b")).alias("mean_diff"))
    tests = signed_rank(rows, "a", "b", ["comparison"]).select("comparison", "p_value")
    return means.join(tests, "comparison", "left")
