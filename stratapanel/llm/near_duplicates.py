"""Near-duplicate documents by a chosen-path similarity join over five-word shingles.

Documents with equal shingle sets form a class. Class representatives walk down independent trees: at every
node each picks ``BRANCHES`` of its minwise tokens, and those that pick the same one meet in a child node. Small
nodes are compared exhaustively on signatures, large ones branch again. What may be alike is brought together
once, in groups of bounded size, and every link is confirmed there on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import cut, scratch

#: Two documents are linked if 100 |A and B| >= SIMILARITY |A or B|.
SHINGLE, SIMILARITY = 5, 75
#: Independent trees, branches per node, and how deep a node too large to compare branches on.
TREES, BRANCHES, DEPTH = 6, 2, 5
#: A large node whose documents agree that much with one of them, on average, is taken as a whole: branching would
#: hardly part it. What is linked in it is settled on the full sets.
STOP = 0.3
#: Documents of a node that is compared exhaustively, and of a group that is confirmed in one task.
NODE, GROUP = 64, 128
#: Documents of a large group that all its parts share, and of a block where a key of the index is too large.
PIVOTS, REST = 16, 256
#: The sizes at which the bands of sizes start that the index on full sets keeps apart.
_BANDS = np.unique(np.ceil(1.05 ** np.arange(600)).astype(np.int64))
#: Signatures of the pivots of large nodes are broadcast up to so many nodes (256 bytes each).
BROADCAST_PIVOTS = 20_000
#: Minwise values of a signature, and how many must agree for a pair to be confirmed on the full sets: at
#: similarity 0.75 fewer agree in 1 of 30,000 pairs.
VALUES, ALIKE = 128, 77

#: Edges that one task joins up at a time when components are found.
EDGES = 500_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 2**63, VALUES + TREES * BRANCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CACHE_WORDS = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes (64 bit) of the distinct shingles of a text, lower-cased in A-Z only."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out * _MIX) ^ h[k : len(h) - width + 1 + k]
        out ^= out >> np.uint64(29)
    return np.unique(out * _MIX)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of the hash functions."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        out = np.minimum(out, (shingles[start : start + 1024, None] * _FACTORS).min(axis=0))
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(1)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (np.asarray(out, np.uint64) ^ np.asarray(part).astype(np.uint64)) * _MIX
            out ^= out >> np.uint64(31)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("signature", pa.binary()), ("nodes", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    roots = np.arange(TREES * BRANCHES)
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(1):
            shingles = shingle_set(text.as_py())
            if not len(shingles):
                rows.append((0, None, None, None))
                continue
            values = minwise(shingles)
            nodes = _mixed(roots, values[VALUES:]).view(np.int64)
            rows.append((len(shingles), set_key(shingles), (values[:VALUES] >> np.uint64(48)).astype(np.uint16).tobytes(), nodes.tolist()))
        columns = zip(*rows) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_SIGNED)[1:], strict=True))], schema=_SIGNED)


def _by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by a column: a group that a batch cuts waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        border = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if held and (border or held[-1].column(column)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, border)])
            held = []
        elif border:
            yield pa.Table.from_batches([batch.slice(0, border)])
        held.append(batch.slice(border))
    if held:
        yield pa.Table.from_batches(held)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    borders = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    yield from zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joined(n: int, alike: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs that connect the parts of a symmetric relation, no more than ``n`` - 1."""
    unseen = np.ones(n, bool)
    for root in range(n):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            for other in np.flatnonzero(alike[at] & unseen).tolist():
                unseen[other] = False
                queue.append(other)
                yield at, other


def _compare_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of like signatures that connect the documents of each node."""
    for rows in _by_group(batches, "node"):
        ids, values = rows.column("id").to_numpy(), _signatures(rows.column("signature"))
        a, b = [], []
        for start, end in _runs(rows.column("node").to_numpy()):
            part = values[start:end]
            alike = (part[:, None] == part[None]).sum(axis=2) >= ALIKE
            for i, j in _joined(end - start, alike):
                a.append(int(ids[start + i]))
                b.append(int(ids[start + j]))
        yield _pairs(a, b)


def _children(node: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The child nodes of documents, one row each: which minwise tokens are picked depends on the node alone."""
    node, rows = node.view(np.uint64), np.arange(len(node))
    first = (_mixed(node) % np.uint64(VALUES)).astype(np.int64)
    step = 1 + (_mixed(node, 7) % np.uint64(VALUES - 1)).astype(np.int64)
    return np.stack([_mixed(node, branch, values[rows, (first + branch * step) % VALUES]).view(np.int64) for branch in range(BRANCHES)], axis=1)


_AGREED = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("least", pa.int64()), ("share", pa.float64()), ("children", pa.list_(pa.int64()))])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How much of a document's signature agrees with that of its node's pivot, and where it goes if the node branches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own, pivot = (_signatures(pa.chunked_array([batch.column(k)])) for k in (3, 4))
        children = _children(batch.column(0).to_numpy(), own)
        lists = pa.ListArray.from_arrays(np.arange(0, children.size + 1, BRANCHES, dtype=np.int32), children.ravel())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((own == pivot).mean(axis=1)), lists], schema=_AGREED)


class _Sets:
    """Shingle sets of one group, as numbers within the group, to compare one with many at once."""

    def __init__(self, texts: list[str]) -> None:
        sets = [shingle_set(text) for text in texts]
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        universe, self.members = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(universe), bool)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)

    def like(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the documents marked in ``others`` are linked with ``one``."""
        own = self.members[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.mark[own] = True
        near = others & (100 * np.minimum(self.sizes, self.sizes[one]) >= SIMILARITY * np.maximum(self.sizes, self.sizes[one]))
        out = np.zeros(len(self.sizes), bool)
        chosen = np.flatnonzero(near)
        if len(chosen) * 4 < len(near):
            shared = np.array([np.count_nonzero(self.mark[self.members[self.starts[k] : self.starts[k] + self.sizes[k]]]) for k in chosen], np.int64)
        else:
            shared = np.bincount(self.owner, self.mark[self.members], len(self.sizes)).astype(np.int64)[chosen]
        out[chosen] = 100 * shared >= SIMILARITY * (self.sizes[one] + self.sizes[chosen] - shared)
        self.mark[own] = False
        return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, confirmed on the full sets, that connect the documents of each group.

    From a document on, whatever is linked to the part found so far is added to it; a document inside a part
    need not be compared with the others inside.
    """
    for rows in _by_group(batches, "part"):
        keys, ids, texts = rows.column("part").to_numpy(), rows.column("id").to_numpy(), rows.column("text")
        a, b = [], []
        for start, end in _runs(keys):
            sets = _Sets(texts.slice(start, end - start).to_pylist())
            unseen = np.ones(end - start, bool)
            for root in range(end - start):
                if not unseen[root]:
                    continue
                unseen[root] = False
                queue = [root]
                while queue and unseen.any():
                    at = queue.pop()
                    for other in np.flatnonzero(sets.like(at, unseen)).tolist():
                        unseen[other] = False
                        queue.append(other)
                        a.append(int(ids[start + at]))
                        b.append(int(ids[start + other]))
        yield _pairs(a, b)


def _confirm_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of documents marked ``rest`` with the others of their group: one for each part these belong to."""
    for rows in _by_group(batches, "part"):
        keys, ids, texts = rows.column("part").to_numpy(), rows.column("id").to_numpy(), rows.column("text")
        rest, label = rows.column("rest").to_numpy(zero_copy_only=False), rows.column("label").to_numpy()
        a, b = [], []
        for start, end in _runs(keys):
            sets = _Sets(texts.slice(start, end - start).to_pylist())
            parts = label[start:end].copy()
            for one in np.flatnonzero(rest[start:end]).tolist():
                others = parts != parts[one]
                linked = np.flatnonzero(sets.like(one, others)) if others.any() else []
                for other in linked:
                    if parts[other] != parts[one]:
                        a.append(int(ids[start + one]))
                        b.append(int(ids[start + other]))
                        parts[parts == parts[other]] = parts[one]
        yield _pairs(a, b)


def _least_shared(size: int, other: int) -> int:
    """Shingles that sets of two sizes must share to be linked."""
    return -(-SIMILARITY * (size + other) // (100 + SIMILARITY))


def _list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets with a number of their own (``row``) for each id and set; a shingle has another number in each component."""
    for batch in batches:
        for k in range(batch.num_rows):
            shingles = shingle_set(batch.column("text")[k].as_py())
            component, id_ = (np.uint64(batch.column(name)[k].as_py() & (2**64 - 1)) for name in ("component", "id"))
            row = _mixed(id_, np.frombuffer(set_key(shingles)[:8], np.uint64)).view(np.int64)
            columns = [batch.column("id").slice(k, 1), pa.array(row), pa.array([len(shingles)]), pa.array([_mixed(component, shingles).view(np.int64)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "size", "shingles"])


_KEY = "key bigint, id bigint, component bigint, label bigint, rest boolean"


def _prefix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each band of sizes that a link may reach, the rarest shingles of a set one of which a link must share.

    ``shared`` lists what other sets of the component hold as well, rarest first; the rest of a set comes before it.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            size, component = batch.column("size")[k].as_py(), np.uint64(batch.column("component")[k].as_py() & (2**64 - 1))
            shared = batch.column("shared")[k].values.to_numpy()
            least, most = -(-SIMILARITY * size // 100), 100 * size // SIMILARITY
            own, first, last = (int(np.searchsorted(_BANDS, x, "right")) - 1 for x in (size, least, most))
            found = []
            for band in range(first, last + 1):
                prefix = size - _least_shared(size, max(int(_BANDS[band]), least)) + 1
                limit = max(prefix - (size - len(shared)), 0)
                found.append(_mixed(component, min(own, band), max(own, band), shared[:limit]).view(np.int64))
            keys = np.unique(np.concatenate(found))
            kept = [batch.column(name).take(pa.array(np.full(len(keys), k))) for name in ("id", "component", "label", "rest")]
            yield pa.RecordBatch.from_arrays([pa.array(keys), *kept], names=["key", "id", "component", "label", "rest"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the edges of one task, each id with the smallest id reachable over them; itself left out."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    ids = [k for k in parent if root(k) != k]
    yield _pairs(ids, [root(k) for k in ids])


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) for the ids of undirected edges ``a``, ``b``.

    Each round first joins up what the edges of one task connect (at most about ``EDGES`` of them), then links
    neighbours to the smallest neighbour across tasks by a large and a small star, until nothing changes; where the
    edges left fit in one task, that is all. Smallest
    neighbours are aggregated before they are joined back, so a star of any size is split.
    """

    def stars(e: DataFrame, small: bool) -> DataFrame:
        least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        rows = e.join(least, "a")
        if small:
            linked = rows.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
            return linked.filter("a <> b").distinct()
        return rows.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        tasks = 1 + e.count() // EDGES
        e = cut(e.coalesce(tasks).mapInArrow(_forest, "a bigint, b bigint"))
        if tasks == 1:
            linked = e
            break
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = cut(stars(stars(both, small=False), small=True))
        if state(linked) == state(e):
            break
        e = linked
    return linked.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(linked.select("b", "b").distinct())


def _sorted_by(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def _with_signatures(entries: DataFrame, signatures: DataFrame) -> DataFrame:
    """``id``, ``signature`` and the list ``entries`` of a document's nodes: a signature is looked up once for each document, not for each node."""
    lists = entries.groupBy("id").agg(F.collect_list(F.struct(*(c for c in entries.columns if c != "id"))).alias("entries"))
    return lists.join(signatures, "id").select("id", "signature", "entries")


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of representatives that may be linked; together they connect whatever may be linked.

    ``classes`` holds ``id``, ``signature`` and the nodes below the roots of the trees.
    """
    signatures = classes.select("id", "signature")
    entries = classes.select(F.explode("nodes").alias("node"), "id")
    small, pairs = [], []
    for depth in range(1, DEPTH + 1):
        sizes = entries.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1")
        sizes = cut(sizes)
        few, many = sizes.filter(F.col("n") <= NODE), sizes.filter(F.col("n") > NODE)
        small.append(entries.join(few.select("node"), "node"))
        n_many = many.count()
        if not n_many:
            break
        held = _with_signatures(entries.join(many.select("node", "least"), "node"), signatures if depth == 1 else signatures_below)
        if depth == 1:  # below, only documents of large nodes matter
            held = cut(held)
            signatures_below = held.select("id", "signature")
        pivots = many.select(F.col("least").alias("id")).distinct().join(signatures_below, "id").select(F.col("id").alias("least"), F.col("signature").alias("pivot"))
        if n_many <= BROADCAST_PIVOTS:
            pivots = F.broadcast(pivots)
        large = held.select("id", "signature", F.inline("entries")).join(pivots, "least")
        agreed = cut(large.select("node", "id", "least", "signature", "pivot").mapInArrow(_agreement, "node bigint, id bigint, least bigint, share double, children array<bigint>"))
        alike = agreed.groupBy("node").agg(F.avg("share").alias("share"))
        done = alike.filter(F.col("share") >= (STOP if depth < DEPTH else 0.0)).select("node")
        pairs.append(agreed.join(done, "node").select(F.col("id").alias("a"), F.col("least").alias("b")))
        if depth == DEPTH:
            break
        parted = alike.filter(F.col("share") < STOP).select("node")
        entries = agreed.join(parted, "node").select(F.explode("children").alias("node"), "id")
    members = None
    for level in small:
        lists = level.groupBy("node").agg(F.sort_array(F.collect_set("id")).alias("members")).select("members")
        members = lists if members is None else members.unionAll(lists)
    nodes = members.distinct().select(F.xxhash64("members").alias("node"), F.explode("members").alias("id"))
    compared = _sorted_by(_with_signatures(nodes, signatures).select(F.inline("entries"), "id", "signature"), "node")
    pairs.append(compared.mapInArrow(_compare_nodes, "a bigint, b bigint"))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionAll(more)
    return out


def _spread(col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on an id alone."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def confirmed_links(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` on full sets that connect the representatives as all their links would.

    ``candidates`` holds ``id`` and ``component`` of the candidate pairs, ``texts`` ``id`` and ``text``. A component of up to
    ``GROUP`` documents is one group. A larger one is dealt into parts that share a few pivots; documents not
    connected with the main part that way are looked up in an index on the full sets.
    """
    sizes = candidates.groupBy("component").agg(F.count("*").alias("n"))
    rows = cut(candidates.join(sizes, "component").select("id", "component", "n", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")))
    own = F.floor(_spread(F.col("id"), 1) * F.col("parts")).cast("int")
    is_pivot = (F.col("parts") > 1) & (_spread(F.col("id"), 2) < F.lit(float(PIVOTS)) / F.col("n"))
    places = F.when(is_pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    dealt = rows.select("id", F.explode(places).alias("place"), "component").select("id", F.xxhash64("component", "place").alias("part"))
    grouped = _sorted_by(dealt.join(texts, "id").select("part", "id", "text"), "part")
    links = cut(grouped.mapInArrow(_confirm, "a bigint, b bigint"))
    large = rows.filter("parts > 1")
    if large.isEmpty():
        return links
    label = F.coalesce("label", "id").alias("label")
    labelled = large.join(components(links).withColumnRenamed("component", "label"), "id", "left").select("id", "component", label)
    counts = labelled.groupBy("component", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("component").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    labelled = cut(labelled.join(main, "component").select("id", "component", "label", (F.col("label") != F.col("main")).alias("rest")))
    return links if labelled.isEmpty() else links.unionAll(links_by_prefix(labelled, texts))


def links_by_prefix(labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between documents of unequal ``label``, one of them ``rest``, that connect what all such links connect.

    An index on the full sets: within a ``component`` the rarest shingles come first, and two sets can be linked only if
    they share one of so many of the first. Documents that share none with another label are out; without them more
    shingles are rare, so this is repeated as long as it helps. What is left is compared key by key or, where these
    groups hold more rows in all, component by component; groups of more than ``GROUP`` documents in blocks.
    """
    sets = cut(labelled.select("id", "component").join(texts, "id").mapInArrow(_list_sets, "id bigint, row bigint, size bigint, shingles array<bigint>"))
    left = labelled.count()
    while True:
        each = sets.select("row", F.explode("shingles").alias("shingle"))
        often = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
        ordered = F.transform(F.sort_array(F.collect_set(F.struct("n", "shingle"))), lambda x: x["shingle"]).alias("shared")
        lists = each.join(often, "shingle").groupBy("row").agg(ordered).join(sets.select("row", "id", "size").distinct(), "row")
        keys = cut(lists.join(labelled, "id").select("id", "component", "size", "label", "rest", "shared").mapInArrow(_prefix_keys, _KEY))
        alike = [F.count("*").alias("n"), F.count_if("rest").alias("n_rest"), F.bit_xor(F.xxhash64("id")).alias("met"), F.min("label").alias("low"), F.max("label").alias("high")]
        stats = cut(keys.groupBy("key", "component").agg(*alike).filter("n_rest > 0 and low < high"))
        alive = cut(keys.join(stats.select("key"), "key").select("id", "component", "label", "rest").distinct())
        before, left = left, alive.count()
        if left == 0 or left > 0.9 * before:
            break
        sets = sets.join(alive.select("id"), "id", "left_semi")
    blocks = F.when(F.col("n") <= GROUP, 0).otherwise(F.ceil(F.col("n_rest") / REST)).cast("int").alias("blocks")
    parts = F.ceil(F.col("n") / REST).cast("int").alias("parts")
    cost = F.when(F.col("blocks") == 0, F.col("n")).otherwise(F.col("n") * F.col("blocks") + F.col("n_rest") * F.col("parts"))
    by_key = stats.groupBy("component", "n", "n_rest", "met").agg(F.min("key").alias("key")).select("component", "key", "n", "n_rest", parts, blocks)
    at_once = alive.groupBy("component").agg(F.count("*").alias("n"), F.count_if("rest").alias("n_rest")).select("component", parts, blocks, "n", "n_rest")
    dearer = by_key.groupBy("component").agg(F.sum(cost).alias("rows")).join(at_once.select("component", cost.alias("rows_at_once")), "component")
    dearer = cut(dearer.filter("rows > rows_at_once").select("component"))
    columns = ["key", "id", "label", "rest", "parts", "blocks"]
    rows = keys.join(by_key.join(dearer, "component", "left_anti").drop("component"), "key").select(columns)
    rows = cut(rows.unionAll(alive.join(at_once.join(dearer, "component"), "component").withColumn("key", F.col("component")).select(columns)))
    whole = rows.filter("blocks = 0").select("id", "label", "rest", F.xxhash64("key").alias("part"))
    blocked = rows.filter("blocks > 0")
    place, block = (F.floor(_spread(F.col("id"), seed) * F.col(n)).cast("int") for seed, n in ((1, "parts"), (3, "blocks")))
    asking = blocked.filter("rest").select("key", "id", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("place"), block.alias("block"), F.lit(True).alias("rest"))
    asked = blocked.select("key", "id", "label", place.alias("place"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("rest"))
    blocks = asking.unionAll(asked).select("id", "label", "rest", F.xxhash64("key", "place", "block").alias("part"))
    compared = _sorted_by(whole.unionAll(blocks).join(texts, "id").select("part", "id", "label", "rest", "text"), "part")
    return cut(compared.mapInArrow(_confirm_rest, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept``.

    Texts of fewer than five words are one shingle; null, empty or blank texts have none, link with nothing and are
    kept. Rows of equal sets are one class whatever their ids; a class of null ids alone is its own component
    (null) and kept. Repeated rows get equal results. An empty table gives no rows; other columns are not read.
    Only signatures and ids are shuffled for all documents, texts only for those with a candidate.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(slim.mapInArrow(_sign, "doc_id bigint, n_shingles bigint, class binary, signature binary, nodes array<bigint>"))
    known = signed.filter(F.col("n_shingles") > 0)
    classes = known.groupBy("class").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.first("signature").alias("signature"), F.first("nodes").alias("nodes"))
    classes = cut(classes.filter(F.col("id").isNotNull()))
    texts = slim.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull())
    with scratch(docs.sparkSession) as keep:
        candidates = keep(components(candidate_pairs(classes)))
    with scratch(docs.sparkSession) as keep:
        final = keep(components(confirmed_links(candidates, texts)))
    found = classes.select("class", "id", "rows").join(final, "id", "left").select("class", "rows", "id", F.coalesce("component", "id").alias("component_id"))
    moved = found.filter((F.col("rows") > 1) | (F.col("component_id") != F.col("id"))).select("class", "component_id")
    out = signed.select("doc_id", "n_shingles", "class").join(moved, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
