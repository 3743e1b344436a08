"""Repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Every window of ``WINDOW`` words holds an anchor: its smallest five-and-twenty-word factor by hash. Equal windows have equal
anchors, so a window can only occur in documents that hold its anchor. The first document (smallest id) with an anchor is
the reference of its windows: its stretches around such anchors are a reference block, and the stretches of other
documents are factored greedily against the blocks of their anchors by a suffix array of the block. Factors of at least
``WINDOW`` words are duplicate spans. At factor boundaries windows are left that hold a shared anchor but are not in its
reference block; all documents with such a window leave it open too, so these few are compared among themselves by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema, cut
from stratapanel.llm.sequence_index import FactorRanks, WordIds

#: Words of a passage, and of an anchor.
WINDOW, ANCHOR = 50, 25
#: Words that are indexed together in a task.
WORDS = 200_000
#: Keys that the documents of one reference block, the copies of one text, and the texts of one anchor are dealt out to.
SALTS, COPY_SALTS, ANCHOR_SALTS = 1024, 256, 64
#: Words whose numbers or hashes a task remembers; only speed depends on it.
REMEMBERED = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchors(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all documents in a row: where they start, where their anchor starts, and its hash.

    Positions count through the documents; windows do not cross from one to the next.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    if sizes.max(initial=0) < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),)
    value = np.fromiter((_hashes[w] for doc in words for w in doc), np.uint64, int(sizes.sum()))
    with np.errstate(over="ignore"):
        done = 1
        value = value * _MIX
        while done < ANCHOR:  # two overlapping factors make a longer one
            step = min(done, ANCHOR - done)
            value = (value[:-step] * _MIX ^ value[step:]) * _MIX
            value ^= value >> np.uint64(29)
            done += step
    first = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - WINDOW + 1, 0)
    starts = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    span = WINDOW - ANCHOR + 1
    views = np.lib.stride_tricks.sliding_window_view(value, span)
    places = np.empty(len(starts), np.int64)
    for low in range(0, len(starts), 1 << 16):
        part = starts[low : low + (1 << 16)]
        places[low : low + (1 << 16)] = part + views[part].argmin(axis=1)
    return starts, places, value[places].view(np.int64)


_ANCHORED = "doc_id long, class binary, anchors array<long>, places array<long>"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_ANCHORED)
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            words = [split(t.as_py()) for t in part.column(2)]
            _, places, values = anchors(words)
            places, at = np.unique(places, return_index=True)
            borders = np.concatenate(([0], np.cumsum([len(w) for w in words])))
            cuts = np.searchsorted(places, borders)
            offsets = pa.array(cuts, pa.int32())
            owner = np.repeat(np.arange(len(words)), np.diff(cuts))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in (values[at], places - borders[owner])]
            rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], schema=schema)
            yield rows.filter(pa.array(np.diff(cuts) > 0))


_SEGMENT = "reference long, salt long, is_query boolean, id long, class binary, start long, more boolean, words string"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a document whose windows have the same reference; ``more`` if a third document holds an anchor."""
    schema = arrow_schema(_SEGMENT)
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, key, text, places, firsts, manies in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words = split(text)
            starts, at, _ = anchors([words])
            order = np.argsort(places)
            shared = np.array(places, np.int64)[order]
            found = np.minimum(np.searchsorted(shared, at), len(shared) - 1)
            known = shared[found] == at
            reference = np.array(firsts, np.int64)[order][found]
            more = np.array(manies, bool)[order][found]
            new = (known[1:] != known[:-1]) | (reference[1:] != reference[:-1]) | (more[1:] != more[:-1])
            borders = [0, *(np.flatnonzero(new) + 1).tolist(), len(starts)]
            salt = int.from_bytes(key[:4], "little") % SALTS
            for low, high in zip(borders[:-1], borders[1:], strict=True):
                if known[low]:
                    first, is_query = int(reference[low]), int(reference[low]) != doc_id
                    stretch = b" ".join(words[low : high + WINDOW - 1]).decode("utf-8", "surrogatepass")
                    rows.append((first, salt if is_query else None, is_query, doc_id, key, low, bool(more[low]), stretch))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def matches(blocks: list[list[np.ndarray]], queries: list[tuple[int, np.ndarray]], n_words: int) -> list[np.ndarray]:
    """For each query (number of its block, words) and position the longest factor from there that the block holds."""
    parts = [(b, words, True) for b, held in enumerate(blocks) for words in held] + [(b, words, False) for b, words in queries]
    pieces, is_reference = [], []
    for k, (block, words, reference) in enumerate(parts):  # a separator of its own behind every part
        pieces += [words + np.int64(block) * n_words, np.array([-1 - k])]
        is_reference.append(np.full(len(words) + 1, reference))
    symbols, reference = np.concatenate(pieces), np.concatenate(is_reference)
    factors = FactorRanks(symbols)
    known = reference[factors.order]
    slots = np.arange(len(symbols))
    before = np.maximum.accumulate(np.where(known, slots, -1))
    after = np.minimum.accumulate(np.where(known, slots, len(symbols))[::-1])[::-1]
    slot_of = np.empty(len(symbols), np.int64)
    slot_of[factors.order] = slots
    start = len(symbols) - sum(len(words) + 1 for _, words in queries)
    own = np.arange(start, len(symbols))
    best = np.zeros(len(own), np.int64)
    for near in (before[slot_of[own]], after[slot_of[own]]):
        some = (near >= 0) & (near < len(symbols))
        best[some] = np.maximum(best[some], factors.forward(own[some], factors.order[near[some]]))
    borders = np.cumsum([0, *[len(words) + 1 for _, words in queries]])
    return [best[low : high - 1] for low, high in zip(borders[:-1], borders[1:], strict=True)]


def parse(longest: np.ndarray, least: int = WINDOW) -> list[tuple[int, int]]:
    """The factors (start, end) of at least ``least`` words of a greedy parse.

    Behind a factor the windows over its boundary are tried in order before the parse goes on at the boundary, so every
    window that the block holds lies in a factor.
    """
    long, out, at = np.flatnonzero(longest >= least), [], 0
    while True:
        k = int(np.searchsorted(long, at))
        if k == len(long):
            return out
        start = int(long[k])
        end = start + int(longest[start])
        out.append((start, end))
        at = end - least + 1


_PARSED = "class binary, id long, window binary, start long, end long"


def _factor(batches: Iterable[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """Spans of sorted segments, reference blocks first; open windows carry the hash of their words."""
    schema, ids = arrow_schema(_PARSED), WordIds()
    blocks: list[list[np.ndarray]] = []
    queries: list[tuple] = []
    size, group = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found = matches(blocks, [(q[0], q[1]) for q in queries], len(ids) + 1)
        for (_, _, doc_id, key, start, more, words), longest in zip(queries, found, strict=True):
            factors = parse(longest)
            rows += [(key, doc_id, None, start + low, start + high) for low, high in factors]
            if more:
                for k in np.flatnonzero(longest[: len(words) - WINDOW + 1] < WINDOW).tolist():
                    window = hashlib.blake2b(b" ".join(words[k : k + WINDOW]), digest_size=16).digest()
                    rows.append((key, doc_id, window, start + k, start + k + WINDOW))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    for batch in batches:
        for reference, salt, is_query, doc_id, key, start, more, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words = split(text)
            if size + len(words) > together and queries:  # the block under way is needed again by its next queries
                yield from flush()
                blocks = blocks[-1:] if (reference, salt) == group else []
                queries = []
                if len(ids) > REMEMBERED:
                    again = {number: word for word, number in ids.items()}
                    ids.clear()
                    blocks = [[np.fromiter((ids[again[n]] for n in part.tolist()), np.int64, len(part)) for part in held] for held in blocks]
                size = sum(len(part) for held in blocks for part in held)
            if (reference, salt) != group:
                group = reference, salt
                blocks.append([])
            numbers = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            size += len(words)
            if is_query:
                queries.append((len(blocks) - 1, numbers, doc_id, key, start, more, words))
            else:
                blocks[-1].append(numbers)
    if queries:
        yield from flush()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("doc_id long, n_words long, n_removed long, kept string")
    for batch in batches:
        rows = []
        for doc_id, text, first, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            words = split(text)
            kept = words
            if first is not None and doc_id is not None and doc_id > first:  # a copy of a whole text
                kept = []
            elif spans and doc_id is not None:
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, [s["start"] for s in spans], 1)
                np.add.at(covered, [s["end"] for s in spans], -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(covered[:-1]) == 0).tolist()]
            rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        columns = zip(*rows) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ddl(ddl: str) -> str:
    return ddl.replace("long", "bigint")


def repeated_spans(classes: DataFrame, texts: DataFrame, together: int = WORDS) -> DataFrame:
    """Spans ``class``, ``start``, ``end`` of words whose windows occur in a text of a smaller ``id``.

    ``classes`` holds one row per distinct text: ``class``, ``id``, ``anchors``, ``places``; ``texts`` ``doc_id``, ``class``, ``text``.
    """
    entries = classes.select("class", "id", F.explode(F.arrays_zip("anchors", "places")).alias("e")).select("class", "id", "e.anchors", "e.places")
    # An anchor that very many texts hold is dealt out: its row goes to every salt that its texts have.
    entries = entries.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(ANCHOR_SALTS)).cast("int"))
    salts = F.bit_or(F.expr("shiftleft(1L, salt)"))
    shared = entries.groupBy("anchors").agg(F.min("id").alias("first"), F.max("id").alias("last"), (F.count("*") > 2).alias("more"), salts.alias("salts"))
    every = F.sequence(F.lit(0), F.lit(ANCHOR_SALTS - 1))
    dealt = shared.filter("first < last").withColumn("salt", F.explode(F.filter(every, lambda k: F.getbit("salts", k) == 1)))
    hits = entries.join(dealt.drop("salts", "last"), ["anchors", "salt"]).groupBy("class", "id")
    lists = hits.agg(*[F.collect_list(F.col(c)).alias(c) for c in ("places", "first", "more")])
    found = texts.join(lists, (texts["class"] == lists["class"]) & (texts["doc_id"] == lists["id"]))
    once = found.select("id", lists["class"], "text", "places", "first", "more").dropDuplicates(["id", "class"])
    segments = cut(once.mapInArrow(_segments, _ddl(_SEGMENT)))
    queries, blocks = segments.filter("is_query"), segments.filter("not is_query")
    wanted = queries.select(F.col("reference").alias("of"), F.col("salt").alias("to")).distinct()
    dealt = blocks.join(wanted, F.col("reference") == F.col("of")).select("reference", F.col("to").alias("salt"), *segments.columns[2:])
    ordered = queries.unionAll(dealt).repartition("reference", "salt").sortWithinPartitions("reference", "salt", "is_query")
    parsed = cut(ordered.mapInArrow(partial(_factor, together=together), _ddl(_PARSED)))
    open_windows = parsed.filter("window is not null")
    least = open_windows.groupBy(F.col("window").alias("same")).agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    late = open_windows.join(least, (F.col("window") == F.col("same")) & (F.col("id") > F.col("first")))
    return parsed.filter("window is null").select("class", "start", "end").unionAll(late.select("class", "start", "end"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: int = WORDS) -> DataFrame:
    """Per input row ``doc_id``, ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space.

    A word goes if one of the windows of 50 words over it also occurs in a document of a smaller id. Documents of one id
    do not remove each other; documents without id neither remove nor lose anything. Null, empty, blank and shorter texts
    are kept. An empty table gives no rows; other columns are not read. Equal texts are factored once; the documents
    of a reference block are dealt out, and a task indexes about ``together`` words at a time, or one block and one stretch if they have more.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.select("doc_id", F.unhex(F.md5("text")).alias("class"), "text")
    anchored = keyed.filter(F.col("doc_id").isNotNull()).mapInArrow(_anchor_rows, _ddl(_ANCHORED))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(COPY_SALTS))
    classes = cut(
        anchored.groupBy("class").agg(
            F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.collect_set(salt).alias("salts"), F.first("anchors").alias("anchors"), F.first("places").alias("places")
        )
    )
    spans = repeated_spans(classes, keyed, together).groupBy("class").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = classes.join(spans, "class", "left").filter("spans is not null or id < last")
    told = found.select(F.col("class").alias("told"), F.col("id").alias("first"), "spans", F.explode("salts").alias("to"))
    rows = keyed.withColumn("salt", salt).join(told, (F.col("class") == F.col("told")) & (F.col("salt") == F.col("to")), "left")
    return rows.select("doc_id", "text", "first", "spans").mapInArrow(_remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
