"""Elastic net logistic regression for many settings and training sets in shared passes.

Every fit is a proximal Newton method. One pass over the rows sums the reweighted normal equations of all fits that have
not come to rest; the tasks of the next stage add them up block by block and solve the short problems by coordinate
descent, so the driver only sees coefficients. Rows are read once per pass however many draws, repeats, folds and outer
folds there are. Features are centred and scaled by the training rows of each fit, as a map of the summed matrices.

Fits of one setting whose training sets leave out one fold each of the same rows lie close together. They start from the fit
to all these rows and use its matrix, so a pass only sums their gradients; one that does not settle so gets its own matrix.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stratapanel.operators.classify import RAPID, SLOW, draw_parameters, stratified_folds, with_target
from stratapanel.operators.metrics import confusion
from stratapanel.operators.partials import BLOCK, SCHEMA, added, emitted, total as total_of
from stratapanel.operators.ranks import position_by_hash
from stratapanel.session import materialize

#: Numbers a task holds at a time.
CHUNK = 2_000_000
#: Rows that meet the coefficients at a time; their short tables stay in the processor's cache.
ROWS = 2_000
#: Fits of one setting and the same rows but a fold share a matrix from so many on, while each step is shorter by this factor.
FAMILY, SHRINK = 4, 0.25
#: At rest when no coefficient moves by more; a fit that never does is reported as such.
TOLERANCE, PASSES = 1e-7, 60


@dataclass(frozen=True)
class Fit:
    """Penalty ``reg * (mix * |b| + (1 - mix) / 2 * b^2)``, fitted to rows outside the ``held`` folds.

    ``held`` lists ``(place in the folds column, fold)``. The rows of the last held fold, outside the others, are the test.
    """

    mix: float
    reg: float
    held: tuple[tuple[int, int], ...] = ()


@dataclass
class Solutions:
    """For every fit the coefficients of the scaled features, and intercept and slopes of the features as they are."""

    scaled: np.ndarray
    raw: np.ndarray
    passes: np.ndarray
    at_rest: np.ndarray

    def part(self, at) -> Solutions:
        """Of the fits at these places."""
        return Solutions(self.scaled[at], self.raw[at], self.passes[at], self.at_rest[at])


def _inside(folds: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which rows each list of held folds leaves for training; a place of -1 holds nothing."""
    out = np.ones((len(folds), len(held)), bool)
    for k in range(held.shape[1]):
        out &= (held[None, :, k, 0] < 0) | (folds[:, held[:, k, 0]] != held[None, :, k, 1])
    return out


def _held(fits: Sequence[Fit]) -> np.ndarray:
    width = max((len(f.held) for f in fits), default=0) or 1
    return np.array([[*f.held, *[(-1, -1)] * (width - len(f.held))] for f in fits], np.int64).reshape(len(fits), width, 2)


def _parts(batches: Iterator[pd.DataFrame], features: list[str], mean: np.ndarray, sd: np.ndarray, columns: int) -> Iterator[tuple]:
    """Rows as arrays, few enough that ``columns`` numbers a row can be held: globally scaled features with a leading 1."""
    step = max(1, CHUNK // max(columns, 1))
    for batch in batches:
        x = (batch[features].to_numpy(float) - mean) / sd
        y, folds = batch["y"].to_numpy(float), np.stack(batch["folds"]) if len(batch) else np.zeros((0, 1), int)
        for low in range(0, len(batch), step):
            part = slice(low, low + step)
            yield np.column_stack((np.ones(len(x[part])), x[part])), y[part], folds[part]


def _descent(h: np.ndarray, g: np.ndarray, start: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimises b'hb/2 - g'b plus the penalties for a stack of problems; the first coefficient is free.

    Sweeps over the coordinates find which coefficients are not zero and their signs; for these the problem is linear. Its
    solution is taken where it keeps the signs and no zero coefficient would move; the other problems are swept on.
    """
    out = start.copy()
    todo = np.arange(len(out))
    for _ in range(100):
        at_h, at_g, at_1, at_2, b = h[todo], g[todo], l1[todo], l2[todo], out[todo]
        diagonal = np.einsum("cjj->cj", at_h) + 1e-12
        slope = at_g - np.einsum("cij,cj->ci", at_h, b)
        for _ in range(10):
            for j in range(b.shape[1]):
                z = slope[:, j] + diagonal[:, j] * b[:, j]
                new = np.sign(z) * np.maximum(np.abs(z) - at_1[:, j], 0.0) / (diagonal[:, j] + at_2[:, j])
                slope -= at_h[:, :, j] * (new - b[:, j])[:, None]
                b[:, j] = new
        sign = np.sign(b)
        on = (sign != 0) | (at_1 + at_2 == 0)
        system = np.where(on[:, :, None] & on[:, None, :], at_h, 0.0)
        np.einsum("cjj->cj", system)[:] += np.where(on, at_2 + 1e-12, 1.0)
        exact = np.linalg.solve(system, np.where(on, at_g - at_1 * sign, 0.0)[:, :, None])[:, :, 0]
        pull = np.abs(at_g - np.einsum("cij,cj->ci", at_h, exact))
        fits = np.where(on, (np.sign(exact) == sign) | (at_1 == 0), pull <= at_1 + 1e-9).all(axis=1)
        out[todo] = np.where(fits[:, None], exact, b)
        todo = todo[~fits]
        if not len(todo):
            break
    return out


def _scales(df: DataFrame, features: list[str], held: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> tuple:
    """Rows, mean and deviation of the (globally scaled) features, and sums of (1, feature) times ``y``, of every training set."""
    p = len(features)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(held), 3 * p + 2))
        for x, y, folds in _parts(batches, features, mean, sd, len(held)):
            total += _inside(folds, held).T.astype(float) @ np.column_stack((x, x[:, 1:] ** 2, x * y[:, None]))
        yield emitted(total)

    sums = total_of(df, work, len(held), 3 * p + 2)
    n = sums[:, 0]
    centre = sums[:, 1 : p + 1] / n[:, None]
    variance = np.maximum(sums[:, p + 1 : 2 * p + 1] - n[:, None] * centre**2, 0.0) / np.maximum(n - 1, 1)[:, None]
    scale = np.sqrt(variance)
    return n, centre, np.where(scale > 1e-12, scale, 0.0), sums[:, 2 * p + 1 :]


def _map(centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Matrices that turn (1, feature) into (1, feature scaled by the training rows); a constant feature becomes 0."""
    back = np.where(scale > 0, 1.0 / np.where(scale > 0, scale, 1.0), 0.0)
    out = np.zeros((len(centre), centre.shape[1] + 1, centre.shape[1] + 1))
    out[:, 0, 0] = 1.0
    out[:, 0, 1:] = -centre * back
    np.einsum("cjj->cj", out)[:, 1:] = back
    return out


def _global_scale(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    row = df.agg(*[f(c) for f in (F.avg, F.stddev_samp) for c in features]).first()
    mean, sd = (np.array([v or 0.0 for v in part]) for part in (row[: len(features)], row[len(features) :]))
    return mean, np.where(sd > 0, sd, 1.0)


def _families(fits: Sequence[Fit]) -> tuple[list[Fit], np.ndarray]:
    """The fits, with those to all rows of a family added, and for each its place among them: -1 for a fit on its own, as every head is."""
    wider = [Fit(f.mix, f.reg, f.held[:-1]) if f.held else None for f in fits]
    sizes = Counter(wider)
    heads = {f for f, size in sizes.items() if f is not None and size >= FAMILY}
    place = {f: k for k, f in reversed([*enumerate(fits)]) if f in heads}
    everything = [*fits, *(f for f in sizes if f in heads and f not in place)]
    place |= {f: k for k, f in enumerate(everything) if k >= len(fits)}
    own = [-1 if f in heads else place.get(w, -1) for f, w in zip(fits, wider)]
    return everything, np.array(own + [-1] * (len(everything) - len(fits)), int)


def _by_set(which: np.ndarray) -> list[tuple[int, int, int]]:
    """Training set, first and last place of each stretch of a sorted list of training sets."""
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    return [*zip(which[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(which)])]


def fit_all(df: DataFrame, features: Sequence[str], fits: Sequence[Fit]) -> Solutions:
    """All fits to ``df``: columns ``y`` (0 or 1), ``folds`` (array of whole numbers) and the features, without missing values."""
    features, p, asked = list(features), len(features), len(fits)
    fits, head = _families(fits)
    context, n_fits = df.sparkSession.sparkContext, len(fits)
    mean, sd = _global_scale(df, features)
    sets, which = np.unique(_held(fits), axis=0, return_inverse=True)
    which = which.reshape(-1)
    n, centre, scale, pull = _scales(df, features, sets, mean, sd)
    maps = _map(centre, scale)
    mix, reg = np.array([f.mix for f in fits]), np.array([f.reg for f in fits])
    free = np.ones(p + 1)
    free[0] = 0.0
    upper = np.triu_indices(p + 1)
    n_upper = len(upper[0])
    beta, before, value = np.zeros((n_fits, p + 1)), np.zeros((n_fits, p + 1)), np.full(n_fits, np.inf)
    passes, at_rest, last = np.zeros(n_fits, int), np.zeros(n_fits, bool), np.full(n_fits, np.inf)
    heads = np.unique(head[head >= 0])
    at_head = np.searchsorted(heads, head)  # of no meaning for a fit on its own
    matrices = np.zeros((len(heads), n_upper))

    def square(table: np.ndarray, maps: np.ndarray) -> np.ndarray:
        h = np.zeros((len(table), p + 1, p + 1))
        h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = table
        return maps.transpose(0, 2, 1) @ h @ maps

    def step(near: np.ndarray, own: np.ndarray) -> np.ndarray:
        """One pass: new coefficients of fits ``near`` their heads and of those with a matrix of their ``own``, which is returned."""
        near, own = (part[np.argsort(which[part], kind="stable")] for part in (near, own))
        stretches = [(sets[k], [], [(low, high)]) for k, low, high in _by_set(which[near])] + [(sets[k], [(low, high)], []) for k, low, high in _by_set(which[own])]
        gammas = [np.einsum("cij,cj->ci", maps[which[part]], beta[part]) for part in (near, own)]
        state = [(which[part], beta[part], before[part], value[part], np.outer((reg * mix)[part], free), np.outer((reg * (1 - mix))[part], free)) for part in (near, own)]
        wanted = np.isin(own, heads)
        shared = context.broadcast((stretches, gammas, state, at_head[near], matrices, wanted, maps, n, pull))
        offset = -(-len(near) // BLOCK) * BLOCK

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            stretches, (gamma_near, gamma_own) = shared.value[:2]
            slopes, full = np.zeros((len(gamma_near), p + 1)), np.zeros((len(gamma_own), n_upper + p + 2))
            for x, _, folds in _parts(batches, features, mean, sd, CHUNK // ROWS):
                pairs = x[:, upper[0]] * x[:, upper[1]] if len(full) else None
                for held, owns, nears in stretches:
                    inside = np.flatnonzero(_inside(folds, held[None])[:, 0])
                    rows = x[inside]
                    for low, high in nears:
                        chance = rows @ -gamma_near[low:high].T
                        np.clip(chance, -40, 40, out=chance)
                        np.exp(chance, out=chance)
                        chance += 1.0
                        np.reciprocal(chance, out=chance)
                        slopes[low:high] += chance.T @ rows
                    for low, high in owns:
                        eta = rows @ gamma_own[low:high].T
                        chance = 1.0 / (1.0 + np.exp(-np.clip(eta, -40, 40)))
                        full[low:high, :n_upper] += (chance * (1 - chance)).T @ pairs[inside]
                        full[low:high, n_upper:-1] += chance.T @ rows
                        full[low:high, -1] += np.logaddexp(0.0, eta).sum(axis=0)
            both = [emitted(slopes), emitted(full)]
            both[1]["block"] += offset
            yield pd.concat(both)

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            _, gammas, state, at, matrices, wanted, maps, n, pull = shared.value
            start = int(frame["block"].iloc[0])
            kind, low = (0, start) if start < offset else (1, start - offset)
            part = slice(low, low + BLOCK)
            ours, beta, before, value, l1, l2 = (v[part] for v in state[kind])
            table = added(frame, p + 1 if kind == 0 else n_upper + p + 2) / n[ours][:, None]
            maps, mine = maps[ours], pull[ours] / n[ours][:, None]
            h = square(matrices[at[part]] if kind == 0 else table[:, :n_upper], maps)
            g = np.einsum("cji,cj->ci", maps, mine - (table if kind == 0 else table[:, n_upper:-1]))
            new = _descent(h, g + np.einsum("cij,cj->ci", h, beta), beta, l1, l2)
            if kind == 1:
                now = table[:, -1] - (mine * gammas[1][part]).sum(axis=1) + (l1 * np.abs(beta) + l2 / 2 * beta**2).sum(axis=1)
                worse = now > value + 1e-12 * (1 + np.abs(value))
                # A step that went too far is halved; its sums are of no further use.
                new = np.where(worse[:, None], (beta + before) / 2, new)
                value, before = np.where(worse, value, now), np.where(worse[:, None], before, beta)
            moved = np.abs(new - beta).max(axis=1)
            out = np.column_stack((value, before, new, moved)).tobytes()
            if kind == 1:
                out += table[wanted[part], :n_upper].tobytes()
            return pd.DataFrame({"block": [start], "sums": [out]})

        moved = np.zeros(n_fits)
        for row in df.mapInPandas(sums, SCHEMA).groupBy("block").applyInPandas(solve, SCHEMA).collect():
            kind, low = (0, row["block"]) if row["block"] < offset else (1, row["block"] - offset)
            at = (near, own)[kind][low : low + BLOCK]
            numbers = np.frombuffer(row["sums"])
            table = numbers[: len(at) * (2 * p + 4)].reshape(len(at), 2 * p + 4)
            value[at], before[at], beta[at], moved[at] = table[:, 0], table[:, 1 : p + 2], table[:, p + 2 : 2 * p + 3], table[:, -1]
            if kind == 1:
                matrices[np.searchsorted(heads, at[wanted[low : low + BLOCK]])] = numbers[table.size :].reshape(-1, n_upper)
        shared.unpersist()
        return moved

    for todo, near in ((head < 0, False), (head >= 0, True)):
        close = todo & near
        if close.any():
            gamma = np.einsum("cij,cj->ci", maps[which[head[close]]], beta[head[close]])
            beta[close] = np.column_stack((gamma[:, 0] + (gamma[:, 1:] * centre[which[close]]).sum(axis=1), gamma[:, 1:] * scale[which[close]]))
            before[close] = beta[close]
        for _ in range(PASSES):
            active = todo & ~at_rest
            if not active.any():
                break
            moved = step(np.flatnonzero(active & close), np.flatnonzero(active & ~close))
            passes[active] += 1
            at_rest |= active & (moved < TOLERANCE)
            close &= ~(moved > SHRINK * last)
            last = np.where(active, moved, last)
    raw = np.einsum("cij,cj->ci", maps[which], beta)
    raw[:, 1:] /= sd
    raw[:, 0] -= raw[:, 1:] @ mean
    return Solutions(beta[:asked], raw[:asked], passes[:asked], at_rest[:asked])


def held_out_counts(df: DataFrame, features: Sequence[str], fits: Sequence[Fit], solutions: Solutions) -> np.ndarray:
    """True and false positives, false and true negatives of every fit on its test rows, in one pass."""
    features, p = list(features), len(features)
    held = _held(fits)
    others = held.copy()
    for k, f in enumerate(fits):
        others[k, max(len(f.held) - 1, 0) :] = -1
    _, which = np.unique(held, axis=0, return_inverse=True)
    order = np.argsort(which.reshape(-1), kind="stable")
    stretches = [(low, high) for _, low, high in _by_set(which.reshape(-1)[order])]
    shared = df.sparkSession.sparkContext.broadcast((solutions.raw[order], held[order], others[order], stretches))
    zero, one = np.zeros(p), np.ones(p)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, held, others, stretches = shared.value
        total = np.zeros((len(raw), 4))
        for x, y, folds in _parts(batches, features, zero, one, CHUNK // ROWS):
            for low, high in stretches:
                test = np.flatnonzero(_inside(folds, others[low : low + 1])[:, 0] & ~_inside(folds, held[low : low + 1])[:, 0])
                said, yes = x[test] @ raw[low:high].T > 0, y[test] > 0.5
                hits, all_yes = (said[yes].sum(axis=0), said[~yes].sum(axis=0)), yes.sum()
                total[low:high] += np.column_stack((*hits, all_yes - hits[0], len(test) - all_yes - hits[1]))
        yield emitted(total)

    out = np.zeros((len(fits), 4))
    out[order] = total_of(df, work, len(fits), 4)
    return out


def _f1(counts: np.ndarray) -> np.ndarray:
    base = 2 * counts[:, 0] + counts[:, 1] + counts[:, 2]
    return np.where(base > 0, 2 * counts[:, 0] / np.where(base > 0, base, 1), 0.0)


def study_folds(df: DataFrame, key: str, label: str, outer: int, folds: int, repeats: int, seed: int) -> DataFrame:
    """``y`` and ``folds``: place 0 the outer fold, then one inner fold a repeat, even within class and outer fold."""
    rows = materialize(stratified_folds(with_target(df, label), key, label, outer, seed, "__f0"), "outer")
    each = rows.select(key, label, "__f0", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("__r"))
    hashed = each.withColumn("__h", F.md5(F.concat_ws("#", F.col(key).cast("string"), (F.lit(seed) + 1000 * F.col("__r")).cast("string"))))
    placed = position_by_hash(hashed, "__h", ["__r", label, "__f0"]).withColumn("__f", (F.col("position") % folds + 1).cast("int"))
    inner = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__r", "__f"))).alias("__i"))
    joined = rows.join(inner, key).withColumn("folds", F.concat(F.array("__f0"), F.col("__i.__f"))).drop("__f0", "__i")
    return materialize(joined, "folds", rebalance=True)


@dataclass
class Study:
    """``draws``: score of every draw by outer fold (0: all rows). ``predictions``: the tuned model of an outer fold on its
    rows. ``coefficients`` of the tuned model of all rows, with ``intercept``, slopes of the features as they are, and its draw."""

    draws: DataFrame
    predictions: DataFrame
    coefficients: DataFrame
    intercept: float
    slopes: dict[str, float]
    best: dict[str, float]


def nested_study(df: DataFrame, key: str, label: str, features: Sequence[str], draws: int = 30, folds: int = 5, repeats: int = 10, outer: int = 5, seed: int = 123) -> Study:
    """Random search by repeated stratified folds, on all rows and inside every outer fold, all in the same passes.

    The best draw has the greatest mean F1 (the first of equals). What is tuned inside an outer fold is refitted to its
    training rows and predicts the fold; what is tuned on all rows is refitted to them. These fits are the heads of the search's.
    """
    spark, features = df.sparkSession, list(features)
    data = study_folds(df, key, label, outer, folds, repeats, seed)
    sets = draw_parameters("GLMNET", len(features), draws, seed)
    cells = [(o, d, r, f) for o in range(outer + 1) for d in range(draws) for r in range(1, repeats + 1) for f in range(1, folds + 1)]
    fits = [Fit(sets[d]["elasticNetParam"], sets[d]["regParam"], (((0, o),) if o else ()) + ((r, f),)) for o, d, r, f in cells]
    whole = [Fit(sets[d]["elasticNetParam"], sets[d]["regParam"], ((0, o),) if o else ()) for o in range(outer + 1) for d in range(draws)]
    solved = fit_all(data, features, [*fits, *whole])
    f1 = _f1(held_out_counts(data, features, fits, solved.part(slice(len(fits))))).reshape(outer + 1, draws, repeats * folds)
    rest = solved.at_rest[: len(fits)].reshape(f1.shape).all(axis=2)
    mean_f1 = f1.mean(axis=2)
    table = [(o, d, float(sets[d]["elasticNetParam"]), float(sets[d]["regParam"]), float(mean_f1[o, d]), float(f1[o, d].std(ddof=1)), bool(rest[o, d])) for o in range(outer + 1) for d in range(draws)]
    best = np.argmax(mean_f1, axis=1)
    tuned = solved.part(len(fits) + np.arange(outer + 1) * draws + best)
    chance = F.lit(None).cast("double")
    for o in range(1, outer + 1):
        eta = sum((F.col(c) * F.lit(float(w)) for c, w in zip(features, tuned.raw[o, 1:])), F.lit(float(tuned.raw[o, 0])))
        chance = F.when(F.col("folds")[0] == o, 1 / (1 + F.exp(-eta))).otherwise(chance)
    scored = data.select(F.col("folds")[0].alias("fold"), key, F.col(label).alias("truth"), chance.alias("prob"))
    predicted = scored.withColumn("pred", F.when(F.col("prob") > 0.5, F.lit(RAPID)).otherwise(F.lit(SLOW)))
    schema = "fold int, draw int, mix double, reg double, mean_f1 double, sd_f1 double, at_rest boolean"
    found = spark.createDataFrame([(c, float(w)) for c, w in zip(features, tuned.scaled[0, 1:])], "feature string, estimate double")
    slopes = {c: float(w) for c, w in zip(features, tuned.raw[0, 1:])}
    return Study(spark.createDataFrame(table, schema), predicted, found, float(tuned.raw[0, 0]), slopes, sets[int(best[0])])


def interpreted(coefficients: DataFrame) -> DataFrame:
    """Odds ratio, direction and importance: absolute values from the smallest, 0, to the largest, 100."""
    size = F.abs("estimate")
    ends = coefficients.agg(F.min(size).alias("least"), F.max(size).alias("most"))
    least, most = ends.select("least").scalar(), ends.select("most").scalar()
    return coefficients.select(
        "feature", "estimate", F.exp("estimate").alias("odds_ratio"),
        F.when(F.col("estimate") > 0, F.lit(f"↑ {RAPID}")).otherwise(F.lit(f"↑ {SLOW}")).alias("direction"),
        F.coalesce(F.try_divide((size - least) * 100.0, most - least), F.lit(0.0)).alias("importance"),
    )


def fold_scores(predictions: DataFrame) -> DataFrame:
    """F1 (0 without positives) and accuracy by outer fold."""
    counts = confusion(predictions, ["fold"])
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select("fold", F.coalesce(f1, F.lit(0.0)).alias("f1"), F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"))
