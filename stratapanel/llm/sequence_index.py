"""Index of a sequence of symbols: ranks of dyadic factors, suffix array, common extensions, range successors.

All methods work on whole arrays of queries at once. Sequences of several documents are indexed together by giving each
document symbols of its own; no factor then crosses a border unseen.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class WordIds(dict):
    """Numbers of words in order of first meeting: equal numbers mean equal words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def tagged(parts: Sequence[np.ndarray], ids: WordIds) -> np.ndarray:
    """Word numbers of several documents in a row, made different between documents."""
    owner = np.repeat(np.arange(len(parts), dtype=np.int64), [len(p) for p in parts])
    return owner * np.int64(len(ids) + 1) + np.concatenate([*parts, np.zeros(0, np.int64)])


class FactorRanks:
    """``ranks[k][i]``: rank of the factor of length 2^k at ``i``, the slot of the first equal one in suffix order.

    Ranks are doubled until all differ; a round sorts only what is still tied. ``order`` is the suffix array. Memory is
    four bytes a symbol for every doubling that the longest repeated factor needs.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = self.n = len(symbols)
        self.order = np.argsort(symbols, kind="stable").astype(np.int64)
        ordered = symbols[self.order]
        rank = np.zeros(n, np.int32)
        rank[self.order] = _firsts(np.concatenate(([True], ordered[1:] != ordered[:-1]))[:n])
        self.ranks = [rank]
        width, tied = 1, self._tied(rank, self.order)
        while len(tied):
            after = tied + width
            following = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
            key = rank[tied].astype(np.int64) * (n + 1) + following + 1
            by_key = np.argsort(key, kind="stable")
            tied, key = tied[by_key], key[by_key]
            group = rank[tied].astype(np.int64)
            base = group - _firsts(np.concatenate(([True], group[1:] != group[:-1])))
            rank = rank.copy()
            rank[tied] = base + _firsts(np.concatenate(([True], key[1:] != key[:-1])))
            self.order[base + np.arange(len(tied))] = tied
            self.ranks.append(rank)
            tied = self._tied(rank, tied)
            width *= 2

    @staticmethod
    def _tied(rank: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Those of the positions, in suffix order, whose factor occurs again."""
        r = rank[positions]
        same = r[1:] == r[:-1]
        return positions[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(r) else positions

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that starts at ``a`` and at ``b`` (different positions)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            x, y = a + out, b + out
            rank, last = self.ranks[k], self.n - 1
            out += ((np.maximum(x, y) <= last) & (rank[np.minimum(x, last)] == rank[np.minimum(y, last)])).astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common factor that ends just before ``a`` and ``b`` (different positions)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            x, y = a - out - (1 << k), b - out - (1 << k)
            rank = self.ranks[k]
            out += ((np.minimum(x, y) >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])).astype(np.int64) << k
        return out


def _firsts(new: np.ndarray) -> np.ndarray:
    """For each element the index of the last one before or at it that is marked."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class WaveletTree:
    """Range counts and range selection over an array of whole numbers, level by level from the highest bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(int(values.max(initial=0)).bit_length(), 1)
        self.zeros = []
        for shift in reversed(range(self.bits)):
            bit = (values >> shift) & 1
            self.zeros.append(np.concatenate(([0], np.cumsum(1 - bit))).astype(np.int32))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many elements of ``[low, high)`` are less than ``value``."""
        over = value >> self.bits > 0
        out = np.where(over, high - low, 0)
        for shift, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            one = ((value >> shift) & 1 == 1) & ~over
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out

    def select(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The element of ``[low, high)`` with ``rank`` smaller ones."""
        out = np.zeros(len(low), np.int64)
        for shift, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = rank >= b - a
            out |= one.astype(np.int64) << shift
            rank = np.where(one, rank - (b - a), rank)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out
