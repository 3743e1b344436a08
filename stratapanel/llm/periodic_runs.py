"""Runs of periodically repeated words, found by matching dyadic blocks inside the text itself.

A run of period q holds an aligned block of 2^k <= q < 2^(k+1) words and the same block q words on. The occurrences of a
block are an interval of the suffix array; a wavelet tree over it gives the first ones in the neighbouring window (range
successor), which form one arithmetic progression. Its terms are the candidate periods; where the block is periodic
itself (three terms or more), the period must bring the borders of both periodic stretches together. A candidate is
extended to both sides by common extensions and kept if long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema
from stratapanel.llm.sequence_index import FactorRanks, WaveletTree, WordIds, tagged

#: A run has so many words and its period so many times over.
LEAST, TIMES = 24, 3
#: Words of documents that are indexed together; a longer document is indexed by itself.
WORDS = 200_000
#: Words whose numbers a task remembers; only speed depends on it.
REMEMBERED = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _occurrences(factors: FactorRanks, scale: int, blocks: np.ndarray, tree: WaveletTree, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of 2^``scale`` symbols that occur again, with their intervals in ``tree``."""
    rank = factors.ranks[scale]
    low = rank[blocks]
    count = np.bincount(rank, minlength=factors.n)[low]
    again = count > 1
    low = place[low[again]]
    return blocks[again], low, low + count[again]


def candidates(factors: FactorRanks, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Positions and possible periods: among them one inside each run, with its period."""
    base = ((least + 1) // TIMES).bit_length() - 1
    if base >= len(factors.ranks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Only suffixes whose shortest block occurs again can be in an interval of two or more.
    count = np.bincount(factors.ranks[base], minlength=factors.n)
    repeated = count[factors.ranks[base][factors.order]] > 1
    place = np.cumsum(repeated) - repeated
    tree = WaveletTree(factors.order[repeated])
    at, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(position: np.ndarray, shift: np.ndarray, fits: np.ndarray) -> None:
        at.append(position[fits])
        period.append(shift[fits])

    for scale in range(base, len(factors.ranks)):
        width = 1 << scale
        blocks = np.arange(0, factors.n - width + 1, width)
        blocks, low, high = _occurrences(factors, scale, blocks, tree, place)
        if not len(blocks):
            break
        if scale == base:  # periods up to the shortest block: its next occurrence
            rank = tree.below(low, high, blocks + 1)
            some = rank < tree.below(low, high, blocks + width)
            add(blocks[some], tree.select(low[some], high[some], rank[some]) - blocks[some], np.ones(some.sum(), bool))
        rank = tree.below(low, high, blocks + width)
        terms = tree.below(low, high, blocks + 2 * width) - rank
        some = terms > 0
        blocks, low, high, rank, terms = (x[some] for x in (blocks, low, high, rank, terms))
        first = tree.select(low, high, rank)
        add(blocks, first - blocks, terms < 3)
        some = terms > 1
        blocks, low, high, rank, terms, first = (x[some] for x in (blocks, low, high, rank, terms, first))
        second = tree.select(low, high, rank + 1)
        add(blocks, second - blocks, terms == 2)
        some = terms > 2
        blocks, first, step = blocks[some], first[some], (second - first)[some]
        ends = (first + factors.forward(first, first + step)) - (blocks + factors.forward(blocks, blocks + step))
        starts = (first - factors.backward(first, first + step)) - (blocks - factors.backward(blocks, blocks + step))
        for shift in (ends, starts):
            add(blocks, shift, (shift >= width) & (shift < 2 * width))
    return np.concatenate(at), np.concatenate(period)


def runs(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start, then period."""
    if len(symbols) < least:
        return np.zeros((0, 3), np.int64)
    factors = FactorRanks(symbols)
    at, period = candidates(factors, least)
    back = factors.backward(at, at + period)
    length = back + period + factors.forward(at, at + period)
    kept = length >= np.maximum(least, TIMES * period)
    start, length, period = (at - back)[kept], length[kept], period[kept]
    # One stretch is found with its period and multiples of it: the smallest counts.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    found = np.stack((start[new], length[new], period[new]), axis=1)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _may_hold_runs(parts: list[np.ndarray], least: int) -> np.ndarray:
    """Documents in which a factor as long as two thirds of the shortest run occurs twice; others hold no run."""
    width = least - least // TIMES
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flags = np.zeros(len(parts), bool)
    if len(owner) < width:
        return flags
    with np.errstate(over="ignore"):
        value = (np.concatenate(parts).astype(np.uint64) + np.uint64(1)) * _MIX ^ owner.astype(np.uint64)
        value ^= value >> np.uint64(31)
        done = 1
        while done < width:  # two overlapping factors make a longer one
            step = min(done, width - done)
            value = (value[:-step] * _MIX ^ value[step:]) * _MIX
            value ^= value >> np.uint64(29)
            done += step
    ordered = np.sort(value)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        flags[owner[: len(value)][np.isin(value, twice)]] = True
    return flags


_OUT = "doc_id long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def _find(batches: Iterator[pa.RecordBatch], least: int, together: int) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_OUT)
    ids = WordIds()
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        symbols = tagged([h[2] for h in held], ids)
        found = runs(symbols, least)
        borders = np.cumsum([0, *[len(h[2]) for h in held]])
        lows = np.searchsorted(found[:, 0], borders[:-1])
        rows = []
        for (doc_id, words, _), border, low, high in zip(held, borders, lows, [*lows[1:], len(found)]):
            own = found[low:high] - [border, 0, 0]
            dropped = np.zeros(len(words) + 1, np.int64)
            np.add.at(dropped, own[:, 0] + own[:, 2], 1)
            np.add.at(dropped, own[:, 0] + own[:, 1], -1)
            kept = np.cumsum(dropped[:-1]) == 0
            text = b" ".join(words if kept.all() else [w for w, k in zip(words, kept) if k])
            rows.append((doc_id, *own.T.tolist(), text.decode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        texts = batch.column(1)
        for first in range(0, batch.num_rows, 512):
            part = texts.slice(first, 512)
            words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in part]
            numbers = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in words]
            maybe = _may_hold_runs(numbers, least)
            doc_ids = batch.column(0).slice(first, 512)
            plain = np.flatnonzero(~maybe).tolist()
            none = [[]] * len(plain)
            joined = [b" ".join(words[k]).decode("utf-8", "surrogatepass") for k in plain]
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(plain, pa.int64())), *[pa.array(none, pa.list_(pa.int64()))] * 3, pa.array(joined, pa.string())], schema=schema)
            for k in np.flatnonzero(maybe).tolist():
                if held and size + len(words[k]) > together:
                    yield from flush()
                    held, size = [], 0
                held.append((doc_ids[k].as_py(), words[k], numbers[k]))
                size += len(words[k])
            if len(ids) > REMEMBERED:
                if held:
                    yield from flush()
                    held, size = [], 0
                ids.clear()
    if held:
        yield from flush()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, together: int = WORDS) -> DataFrame:
    """Per input row ``doc_id``, ``runs`` (array of start, length, period by start, then period; in words from 0) and
    ``collapsed``: the text with each run cut to its first period, words joined by one space.

    A run is a stretch of at least ``least`` words and three times its smallest period that cannot be extended. ``together`` words
    are indexed at a time. Null,
    empty, blank or short texts hold no run. Repeated rows and null ids get rows of their own, an empty table gives
    none, other columns are not read. Documents are independent: nothing is shuffled, and a document is one unit of work
    whose index takes about 150 bytes a word of what repeats in it.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = slim.mapInArrow(lambda batches: _find(batches, least, together), _OUT.replace("long", "bigint"))
    zipped = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return found.select("doc_id", zipped.alias("runs"), "collapsed")
