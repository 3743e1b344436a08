"""A factorization machine for yes-or-no labels over sets of hashed terms.

The log odds of a set of terms are a bias, a weight of each term, and for each pair of terms the product of their
factors, so that two terms together can mean what neither means alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def log_odds(self, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of sets of terms that stand one after another in ``terms``; an empty set has the bias."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(row, self.weights[terms], len(sizes))
        pairs = np.zeros(len(sizes))
        for k in range(self.factors.shape[1]):
            f = self.factors[terms, k]
            pairs += np.bincount(row, f, len(sizes)) ** 2 - np.bincount(row, f * f, len(sizes))
        return self.bias + linear + 0.5 * pairs


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(log_odds, -35, 35)))


def fit(
    terms: np.ndarray, sizes: np.ndarray, labels: np.ndarray, buckets: int, factors: int = 4, epochs: int = 12,
    batch: int = 256, rate: float = 0.15, l1: float = 4e-3, l1_factors: float = 4e-2, l2: float = 1e-4, seed: int = 20,
) -> FactorizationMachine:
    """Fits by steps of adaptive size over shuffled batches.

    Weights shrink towards zero by a constant (``l1``), so that terms without a say get none however many a text
    has; factors of a term shrink together, by ``l1_factors``. No rows give a bias of zero and nothing else; rows of one label alone
    give a bias towards it.
    """
    random = np.random.default_rng(seed)
    w, v = np.zeros(buckets), random.normal(0, 0.02, (buckets, factors))
    v[np.bincount(terms, minlength=buckets) == 0] = 0
    n = len(labels)
    if not n:
        return FactorizationMachine(0.0, w, np.zeros_like(v))
    rate_of_ones = (labels.sum() + 0.5) / (n + 1)
    bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    gw, gv, gb = np.full(buckets, 1e-2), np.full(buckets, 1e-2), 1e-2
    ends = np.cumsum(sizes)
    for _ in range(epochs):
        order = random.permutation(n)
        for start in range(0, n, batch):
            rows = order[start : start + batch]
            count = sizes[rows]
            owner = np.repeat(np.arange(len(rows)), count)
            at = np.repeat(ends[rows] - count - (np.cumsum(count) - count), count) + np.arange(count.sum())
            t = terms[at]
            f = v[t]
            sums = np.stack([np.bincount(owner, f[:, k], len(rows)) for k in range(factors)], axis=1)
            odds = bias + np.bincount(owner, w[t], len(rows)) + 0.5 * ((sums**2).sum(1) - np.bincount(owner, (f * f).sum(1), len(rows)))
            error = probability(odds) - labels[rows]
            touched, place = np.unique(t, return_inverse=True)
            e = error[owner]
            dw = np.bincount(place, e, len(touched)) / len(rows) + l2 * w[touched]
            df = e[:, None] * (sums[owner] - f)
            dv = np.stack([np.bincount(place, df[:, k], len(touched)) for k in range(factors)], axis=1) / len(rows) + l2 * v[touched]
            gw[touched] += dw**2
            gv[touched] += (dv**2).sum(1)
            step = rate / np.sqrt(gw[touched])
            moved = w[touched] - step * dw
            w[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            step = rate / np.sqrt(gv[touched])
            moved = v[touched] - step[:, None] * dv
            norm = np.sqrt((moved**2).sum(1)) + 1e-12
            v[touched] = moved * np.maximum(1 - step * l1_factors / norm, 0)[:, None]
            gb += error.mean() ** 2
            bias -= rate * error.mean() / np.sqrt(gb)
    return FactorizationMachine(bias, w, v)
