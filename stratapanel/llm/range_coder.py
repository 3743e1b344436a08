"""Adaptive context-mixing range coder for token ids.

A block is coded on its own: its model starts empty and its ids carry a checksum. The ids of a block are cut
into lanes that advance together, one id each per step, so that every operation is one over an array; all lanes
share the model, which learns from a step when the step is done.

Three predictions are mixed. Order 2 and order 1 each remember the id that last followed a context, with a
confidence that grows with every hit and shrinks with every miss; how much probability a confidence deserves is
counted as the block goes on. What they leave goes to order 0, the frequencies of all ids so far.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a lane, and the most lanes of a block.
STEPS, LANES = 256, 4096
BLOCK_IDS = STEPS * LANES
#: All probabilities are parts of 2**24; order 0 keeps at least a sixteenth, and an id a sixteenth of 2**-20 of that.
BITS = 24
TOTAL = 1 << BITS
LEAST = 16
CONFIDENCES = 16
ORDER2_BITS = 18

_HEAD = struct.Struct("<IIII")


class _Model:
    def __init__(self, vocabulary: int, lanes: int) -> None:
        self.vocabulary = vocabulary
        self.counts = np.zeros(vocabulary, np.int64)
        self.pending: list[np.ndarray] = []
        self.ids = [np.zeros(1 << ORDER2_BITS, np.int64), np.zeros(vocabulary, np.int64)]
        self.sure = [np.zeros(1 << ORDER2_BITS, np.int64), np.zeros(vocabulary, np.int64)]
        self.hits = np.tile(np.arange(CONFIDENCES, dtype=np.float64) * 2, (2, 1))
        self.tries = np.full((2, CONFIDENCES), 2.0 * CONFIDENCES + 8)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.step = 0
        self._renew()

    def _renew(self) -> None:
        """Tables of order 0 and of the confidences from what was counted so far."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.vocabulary)
            self.pending = []
        seen = int(self.counts.sum())
        spare = TOTAL - LEAST * self.vocabulary
        sizes = LEAST + (self.counts * spare // seen if seen else np.full(self.vocabulary, spare // self.vocabulary))
        sizes[int(np.argmax(sizes))] += TOTAL - int(sizes.sum())
        self.cumulated = np.concatenate(([0], np.cumsum(sizes)))
        self.weights = np.minimum(self.hits / self.tries, 0.74) * (np.arange(CONFIDENCES) > 0)
        self.weights = (self.weights * TOTAL).astype(np.int64)

    def predict(self) -> None:
        """Predictions of the two contexts and the parts of the interval of each, for all lanes."""
        self.at = [(self.last * 40503 + self.before * 30011) & ((1 << ORDER2_BITS) - 1), self.last]
        self.guess = [ids[at] for ids, at in zip(self.ids, self.at, strict=True)]
        self.trust = [sure[at] for sure, at in zip(self.sure, self.at, strict=True)]
        self.w2 = self.weights[0][self.trust[0]]
        self.w1 = ((TOTAL - self.w2) * self.weights[1][self.trust[1]]) >> BITS
        self.w1[self.guess[0] == self.guess[1]] = 0
        self.w12 = self.w2 + self.w1
        self.w0 = TOTAL - self.w12

    def intervals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the interval of each lane's id."""
        by2 = (ids == self.guess[0]) & (self.w2 > 0)
        by1 = (ids == self.guess[1]) & (self.w1 > 0) & ~by2
        low = (self.cumulated[ids] * self.w0 >> BITS) + self.w12
        high = (self.cumulated[ids + 1] * self.w0 >> BITS) + self.w12
        return np.where(by2, 0, np.where(by1, self.w2, low)), np.where(by2, self.w2, np.where(by1, self.w1, high - low))

    def find(self, values: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the given values."""
        rest = np.maximum(values - self.w12, 0)
        upto = (((rest + 1) << BITS) + self.w0 - 1) // self.w0 - 1
        ids = np.searchsorted(self.cumulated, upto, side="right") - 1
        return np.where(values < self.w2, self.guess[0], np.where(values < self.w12, self.guess[1], ids))

    def learn(self, ids: np.ndarray) -> None:
        for order in range(2):
            guess, trust, at = self.guess[order], self.trust[order], self.at[order]
            right = (guess == ids) & (trust > 0)
            self.tries[order] += np.bincount(trust, minlength=CONFIDENCES)
            self.hits[order] += np.bincount(trust[right], minlength=CONFIDENCES)
            replaced = ~right & (trust <= 1)
            self.ids[order][at] = np.where(replaced, ids, guess)
            self.sure[order][at] = np.where(right, np.minimum(trust + 1, CONFIDENCES - 1), np.maximum(trust - 1, 1))
        self.pending.append(ids)
        self.before, self.last = self.last, ids
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 16 == 0:
            self._renew()


_LOW32 = np.uint64(0xFFFFFFFF)
_SHIFT = np.uint64(32)
_BITS = np.uint64(BITS)


def _settle(low: np.ndarray, size: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Makes the intervals of lanes that became narrow end below the next multiple of 2**32, and returns their leading words."""
    start, wide = low[lanes], size[lanes]
    crosses = (start >> _SHIFT) != ((start + wide - np.uint64(1)) >> _SHIFT)
    wide = np.where(crosses, (_LOW32 - (start & _LOW32)) + np.uint64(1), wide)
    low[lanes] = start << _SHIFT
    size[lanes] = wide << _SHIFT
    return start >> _SHIFT


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block: number of ids, vocabulary, lanes, checksum; words of each lane; the words."""
    n = len(ids)
    lanes = max(1, -(-n // STEPS))
    steps = -(-n // lanes)
    lanes = max(1, -(-n // max(1, steps)))
    table = np.zeros((lanes, steps), np.int64)
    table.reshape(-1)[:n] = ids
    model = _Model(vocabulary, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    words, used = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    for step in range(steps):
        now = np.ascontiguousarray(table[:, step])
        model.predict()
        start, part = model.intervals(now)
        unit = size >> _BITS
        low += unit * start.astype(np.uint64)
        size = unit * part.astype(np.uint64)
        narrow = np.flatnonzero(size <= _LOW32)
        words[narrow, used[narrow]] = _settle(low, size, narrow)
        used[narrow] += 1
        model.learn(now)
    every = np.arange(lanes)
    for word in (low >> _SHIFT, low & _LOW32):
        words[every, used] = word
        used += 1
    out = words[np.arange(steps + 2)[None, :] < used[:, None]]
    check = zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
    return _HEAD.pack(n, vocabulary, lanes, check) + used.astype("<u2").tobytes() + out.astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block as unsigned 32-bit integers; a wrong checksum raises an error."""
    n, vocabulary, lanes, check = _HEAD.unpack_from(data)
    used = np.frombuffer(data, "<u2", lanes, _HEAD.size).astype(np.int64)
    flat = np.frombuffer(data, "<u4", offset=_HEAD.size + 2 * lanes)
    if int(used.sum()) != len(flat):
        raise ValueError("a block of token ids is cut off")
    steps = -(-n // lanes)
    width = int(used.max())
    words = np.zeros((lanes, width + 2), np.uint64)
    words[:, :width][np.arange(width)[None, :] < used[:, None]] = flat
    model = _Model(vocabulary, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    code, taken = (words[:, 0] << _SHIFT) | words[:, 1], np.full(lanes, 2)
    table = np.zeros((lanes, steps), np.uint32)
    for step in range(steps):
        model.predict()
        unit = size >> _BITS
        values = np.minimum((code - low) // unit, np.uint64(TOTAL - 1)).astype(np.int64)
        now = model.find(values)
        start, part = model.intervals(now)
        low += unit * start.astype(np.uint64)
        size = unit * part.astype(np.uint64)
        narrow = np.flatnonzero(size <= _LOW32)
        _settle(low, size, narrow)
        code[narrow] = (code[narrow] << _SHIFT) | words[narrow, taken[narrow]]
        taken[narrow] = np.minimum(taken[narrow] + 1, width + 1)
        model.learn(now)
        table[:, step] = now
    ids = table.reshape(-1)[:n]
    if zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes()) != check:
        raise ValueError("a block of token ids differs from its checksum")
    return ids
