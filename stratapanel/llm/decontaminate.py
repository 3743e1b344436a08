"""Finds test items in training texts: passages query a BM25 index of the items by block-max WAND.

A passage is a window of ``WINDOW`` words. An index entry is a test item, or a piece of a long one. Impacts are
divided by the score of the entry against itself, so that a threshold is a share of the entry.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema, by_bytes

#: Words of a passage and between the starts of two; an entry fits whole into some passage.
WINDOW, STRIDE, ENTRY = 128, 64, 64
#: Least share of an entry's own score that a passage must reach.
THRESHOLD = 0.5
#: Least share of the words of question and answer that shared five-word shingles cover.
OVERLAP, SHINGLE = 0.75, 5
#: A question or answer shorter than a shingle is looked for whole, the answer up to so many words after the question;
#: it may begin so many words early where words of the question were left out.
NEAR, EARLY = 16, 2
K1, B = 1.2, 0.75
#: Entries of one block, for which every list has its largest impact.
BLOCK = 8
#: Characters of test items in one index; more items make more indexes, and a scan of the texts for each.
INDEX_CHARS = 64 << 20
#: Characters of texts looked through at a time.
BATCH_CHARS = 4 << 20

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!\n])\s+")


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class ItemIndex:
    """BM25 postings of test items, with the largest impact of each list and of each block of a list."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items, entries = [], []
        for item_id, text in items:
            tokens = normalised(text or "")
            if not tokens:
                continue
            answer = len(normalised(_SENTENCE.split(text.strip())[-1]))
            width = min(SHINGLE, len(tokens))
            shingles: dict[tuple, list[int]] = {}
            for at in range(len(tokens) - width + 1):
                shingles.setdefault(tuple(tokens[at : at + width]), []).append(at)
            split = len(tokens) - answer if answer < len(tokens) else 0
            short = tuple(part if len(part) < SHINGLE else [] for part in (tokens[:split], tokens[split:])) if split else ([], [])
            self.items.append((item_id, len(tokens), split, width, shingles, short))
            entries += [(len(self.items) - 1, tokens[at : at + ENTRY]) for at in range(0, len(tokens), ENTRY)]
        self.n_blocks = max(1, -(-len(entries) // BLOCK))
        self.item_of = [item for item, _ in entries]
        counts = [Counter(tokens) for _, tokens in entries]
        held = Counter(chain.from_iterable(counts))
        mean = sum(len(tokens) for _, tokens in entries) / max(1, len(entries))
        self.term: dict[str, int] = {word: k for k, word in enumerate(held)}
        lists: list[list[tuple[int, float]]] = [[] for _ in held]
        for entry, tf in enumerate(counts):
            norm = K1 * (1 - B + B * len(entries[entry][1]) / mean)
            impact = {w: math.log1p((len(entries) - held[w] + 0.5) / (held[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in tf.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                lists[self.term[w]].append((entry, x / own))
        self.lists = []
        for postings in lists:
            most: dict[int, float] = {}
            for entry, impact in postings:
                most[entry // BLOCK] = max(impact, most.get(entry // BLOCK, 0.0))
            self.lists.append(([e for e, _ in postings], [x for _, x in postings], max(most.values()), most))
        needed = _needed_from_rare(lists, len(entries))
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in needed]))).astype(np.int64)
        self.blocks = np.array([b for x in needed for b in x], np.int64)
        self.shares = np.array([y for x in needed for y in x.values()], np.float64)

    def live_blocks(self, ids: np.ndarray, sizes: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """The blocks of entries that some passage may match, by number of the text and of its passage.

        Bounds of all passages and blocks at once: the distinct terms of a passage bring their largest shares
        in each block, which are summed by passage and block.
        """
        terms, text = len(self.lists), np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        known = np.flatnonzero((ids < terms) & (np.append(np.diff(self.starts), 0)[ids] > 0))
        passages = np.cumsum(np.maximum(1, -(-sizes // STRIDE)))
        first = passages - np.maximum(1, -(-sizes // STRIDE))
        at, term = place[known] // STRIDE, ids[known]
        numbers = [first[text[known]] + at - back for back in range(WINDOW // STRIDE)]
        kept = [at >= back for back in range(WINDOW // STRIDE)]
        keys = np.unique(np.concatenate([(n * terms + term)[k] for n, k in zip(numbers, kept, strict=True)]))
        passage, term = keys // terms, keys % terms
        counts = self.starts[term + 1] - self.starts[term]
        posting = np.repeat(self.starts[term] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        bins, inverse = np.unique(np.repeat(passage, counts) * self.n_blocks + self.blocks[posting], return_inverse=True)
        live: dict[tuple[int, int], list[int]] = {}
        for key in bins[np.bincount(inverse, self.shares[posting], len(bins)) >= 1 - 1e-9]:
            number = int(key // self.n_blocks)
            row = int(np.searchsorted(passages, number, side="right"))
            live.setdefault((row, number - int(first[row])), []).append(int(key % self.n_blocks))
        return live

    def search(self, terms: set[int], blocks: list[int], threshold: float) -> list[tuple[int, float]]:
        """All entries of the given blocks that score at least ``threshold`` against a passage, by block-max WAND."""
        found, cursors = [], [[self.lists[t], 0] for t in terms]
        while cursors:
            cursors.sort(key=lambda c: c[0][0][c[1]])
            total, pivot = 0.0, -1
            for k, (postings, _) in enumerate(cursors):
                total += postings[2]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            entry = cursors[pivot][0][0][cursors[pivot][1]]
            block = entry // BLOCK
            next_live = bisect_left(blocks, block)
            if next_live == len(blocks):
                break
            if blocks[next_live] != block:
                target = blocks[next_live] * BLOCK
            elif sum(postings[3].get(block, 0.0) for postings, _ in cursors) < threshold:
                target = (block + 1) * BLOCK
            else:
                score = 0.0
                for postings, at in cursors:
                    at = bisect_left(postings[0], entry, at)
                    if at < len(postings[0]) and postings[0][at] == entry:
                        score += postings[1][at]
                if score >= threshold:
                    found.append((entry, score))
                target = entry + 1
            for cursor in cursors:
                cursor[1] = bisect_left(cursor[0][0], target, cursor[1])
            cursors = [c for c in cursors if c[1] < len(c[0][0])]
        return found

    def overlaps(self, item: int, tokens: list[str]) -> tuple[float, float]:
        """Shares of the words of an item's question and answer inside shingles that the text has too.

        Words between or changed around the two break the shingles that span both, so a part too short for a
        shingle of its own is covered as well by itself, next to where the other part is found.
        """
        _, n, split, width, shingles, (question, answer) = self.items[item]
        covered, hits = np.zeros(n, bool), []
        for at in range(len(tokens) - width + 1):
            for k in shingles.get(tuple(tokens[at : at + width]), ()):
                covered[k : k + width] = True
                hits.append((at, k))
        if answer and not covered[split:].all():
            if question:
                ends = {at + split for at in _places(tokens, question)}
                taken = {end - 1 - k for end in ends for k in range(split)}
            else:
                inside = [(at, k) for at, k in hits if k + width <= split]
                ends = {at + split - k for at, k in inside}
                taken = {at + j for at, _ in inside for j in range(width)}
            if _beside(_places(tokens, answer), len(answer), ends, taken, -EARLY, NEAR):
                covered[split:] = True
                covered[:split] |= bool(question)
        elif question and not covered[:split].all():
            inside = [(at, k) for at, k in hits if k >= split]
            starts = {at + split - k for at, k in inside}
            taken = {at + j for at, _ in inside for j in range(width)}
            if _beside(_places(tokens, question), split, starts, taken, -NEAR - split, EARLY - split):
                covered[:split] = True
        found = float(covered[split:].mean())
        return (float(covered[:split].mean()) if split else found), found

    def matches(self, texts: list[str]) -> Iterator[list[tuple[int, float, float, float]]]:
        """For each text the verified items: id, score, overlap of question and of answer."""
        for batch in by_bytes(texts, BATCH_CHARS):
            yield from self._matches(batch)

    def _matches(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        unknown = len(self.lists)
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
        if not unknown:
            return out
        ids = [np.fromiter(map(self.term.get, tokens, repeat(unknown)), np.int64, len(tokens)) for tokens in map(normalised, texts)]
        scores: dict[int, dict[int, float]] = {}
        live = self.live_blocks(np.concatenate([np.zeros(0, np.int64), *ids]), np.array([len(x) for x in ids], np.int64))
        for (row, passage), blocks in live.items():
            terms = set(ids[row][passage * STRIDE : passage * STRIDE + WINDOW].tolist()) - {unknown}
            for entry, score in self.search(terms, sorted(blocks), THRESHOLD):
                best = scores.setdefault(row, {})
                best[self.item_of[entry]] = max(score, best.get(self.item_of[entry], 0.0))
        for row, best in scores.items():
            tokens = normalised(texts[row])
            for item, score in best.items():
                question, answer = self.overlaps(item, tokens)
                if min(question, answer) >= OVERLAP:
                    out[row].append((self.items[item][0], score, question, answer))
        return out


def _places(tokens: list[str], part: list[str]) -> list[int]:
    """Where a part begins in a text."""
    return [at for at, word in enumerate(tokens) if word == part[0] and tokens[at : at + len(part)] == part]


def _beside(places: list[int], size: int, anchors: set[int], taken: set[int], low: int, high: int) -> bool:
    """Whether a part begins between ``low`` and ``high`` words from an anchor, on words not taken by the other part."""
    return any(not taken.intersection(range(at, at + size)) and any(at - d in anchors for d in range(low, high + 1)) for at in places)


def _needed_from_rare(lists: list[list[tuple[int, float]]], n_entries: int) -> list[dict[int, float]]:
    """For each term, by block, the most it adds as a share of what an entry must get from its rare terms.

    Terms of many entries give an entry a known part of its score at most. The rest up to the threshold must come
    from rare ones, so a passage whose rare terms add up to less than 1 in a block reaches none of its entries.
    Terms count as rare up to the number of entries at which the others leave every entry something to get.
    """
    most = 2
    while True:
        common = np.zeros(n_entries)
        for postings in lists:
            if len(postings) > most:
                for entry, impact in postings:
                    common[entry] += impact
        if not n_entries or common.max() <= 0.6 * THRESHOLD:
            break
        most *= 2
    out: list[dict[int, float]] = []
    for postings in lists:
        shares: dict[int, float] = {}
        for entry, impact in postings if len(postings) <= most else ():
            shares[entry // BLOCK] = max(impact / (THRESHOLD - common[entry]), shares.get(entry // BLOCK, 0.0))
        out.append(shares)
    return out


def item_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = INDEX_CHARS) -> Iterator[ItemIndex]:
    """Indexes over the test items in order of id, each over at most ``chars`` characters (or one item)."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).orderBy("id", "text")
    held, size = [], 0
    for row in rows.toLocalIterator():
        if held and size + len(row["text"]) > chars:
            yield ItemIndex(held)
            held, size = [], 0
        held.append((row["id"], row["text"]))
        size += len(row["text"])
    if held:
        yield ItemIndex(held)


def leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item in it: ``doc_id``, ``item_id``, ``score``, ``question_overlap``, ``answer_overlap``.

    The last sentence of an item is its answer, the rest its question; an item of one sentence is both. Null or
    blank texts and items match nothing; null ids, repeated rows and repeated items give rows each; empty tables
    give none. Only the named columns are read. The index is of bounded size and is broadcast; more items make
    more indexes, one scan each. Nothing is shuffled.
    """
    columns = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    out = spark.createDataFrame([], columns.replace("long", "bigint"))
    for index in item_indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, *m) for i, found in zip(ids, shared.value.matches(batch.column(1).to_pylist()), strict=True) for m in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, arrow_schema(columns), strict=True)], schema=arrow_schema(columns))

        out = out.unionAll(slim.mapInArrow(run, columns.replace("long", "bigint")))
    return out


def contaminated(spark: SparkSession, items: DataFrame, text: Column) -> Column:
    """Whether a text holds a test item; false for null."""
    out = F.lit(False)
    for index in item_indexes(items):
        out = out | _holds_item(spark.sparkContext.broadcast(index))(F.coalesce(text, F.lit("")))
    return out


def _holds_item(shared: Broadcast):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(found) for found in shared.value.matches(texts.tolist())], dtype=bool)

    return holds
