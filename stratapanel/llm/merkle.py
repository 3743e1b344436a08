"""Merkle manifest of a table by time-forward processing.

A tree of ``FAN`` children a node stands over the rows of every group, and one more over the groups. Node labels are
``(level, index)``: whatever a node needs is sent to its label by nodes of smaller labels, and a priority queue delivers
the messages in label order. Inside a block of 4,096 neighbouring leaves the queue is a heap in one task; what leaves
a block goes to a written table, which the next round reads sorted by label, so that the queue as a whole lies outside
memory. A reversed sweep sends the siblings on the way to the root down to the leaves: the suffixes of their proofs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema, cut

#: Children of a node, and levels that one round climbs: a block has ``FAN`` to that power leaves.
FAN, LEVELS = 16, 3


def spelled(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (binary) of the fields in order."""
    return F.unhex(F.sha2(F.concat(*[spelled(f) for f in fields]), 256))


def _hash(*parts: bytes) -> bytes:
    """Hex digest, as text, of hex digests."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class _Queue:
    """Messages to labels, delivered in the order of labels and, for one label, of places."""

    def __init__(self) -> None:
        self._heap: list[tuple] = []

    def send(self, label: tuple[int, int], place: int, message: object) -> None:
        heapq.heappush(self._heap, (label, place, message))

    def deliveries(self) -> Iterator[tuple[tuple[int, int], list]]:
        """Each label with its messages; those sent meanwhile to later labels are still delivered."""
        while self._heap:
            label, messages = self._heap[0][0], []
            while self._heap and self._heap[0][0] == label:
                messages.append(heapq.heappop(self._heap)[2])
            yield label, messages


def _height(leaves: int, group_size: int, levels: int) -> int:
    """Levels above the leaves of a block: up to the root if the group is one block, else all that a round climbs."""
    if group_size > FAN**levels:
        return levels
    height = 0
    while leaves > 1:
        leaves, height = -(-leaves // FAN), height + 1
    return height


def rise(leaves: list[bytes], height: int) -> dict[tuple[int, int], list[bytes]]:
    """The children of every node, by label; the sweep from the leaves of a block to its root."""
    nodes: dict[tuple[int, int], list[bytes]] = {}
    if not height:
        return nodes
    queue = _Queue()
    for place, digest in enumerate(leaves):
        queue.send((1, place // FAN), place, digest)
    for (level, index), children in queue.deliveries():
        nodes[level, index] = children
        if level < height:
            queue.send((level + 1, index // FAN), index, _hash(*children))
    return nodes


def fall(nodes: dict[tuple[int, int], list[bytes]], height: int, suffix: tuple | None) -> list[tuple | None]:
    """For each leaf its proof from the leaf up: ``(left, right, rest)``, the digests beside it and the proof of its parent.

    The reversed sweep: labels are negated, and a node passes its own proof on to its children.
    """
    if not height:
        return [suffix]
    proofs: list[tuple | None] = []
    queue = _Queue()
    queue.send((-height, 0), 0, suffix)
    for (level, index), (rest,) in queue.deliveries():
        children = nodes[-level, index]
        for place in range(len(children)):
            proof = (b"".join(children[:place]), b"".join(children[place + 1 :]), rest)
            if level == -1:
                proofs.append(proof)
            else:
                queue.send((level + 1, index * FAN + place), 0, proof)
    return proofs


def fold(digest: bytes, proof: tuple | None) -> bytes:
    """The root that a leaf and its proof lead to."""
    while proof is not None:
        left, right, proof = proof
        digest = _hash(left, digest, right)
    return digest


def _flat(proof: tuple | None) -> list[bytes]:
    out = []
    while proof is not None:
        out += proof[:2]
        proof = proof[2]
    return out


def _linked(flat: list[bytes]) -> tuple | None:
    proof = None
    for k in range(len(flat) - 2, -1, -2):
        proof = (flat[k], flat[k + 1], proof)
    return proof


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first two columns, group and block."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    return groupby(rows, key=itemgetter(0, 1))


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 2048:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_ITEM = "group string, place long, group_size long, digest binary"
_MESSAGE = "group string, place long, subroot binary, root binary, proof array<binary>"


def _schema(ddl: str) -> pa.Schema:
    plain = arrow_schema(", ".join(x for x in ddl.split(", ") if "array<binary>" not in x))
    lists = [pa.field(x.split()[0], pa.list_(pa.binary())) for x in ddl.split(", ") if "array<binary>" in x]
    return pa.schema([*plain, *lists])


def _by_task(work: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple]], ddl: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(work(batches), _schema(ddl))

    return run


def _block_roots(batches: Iterable[pa.RecordBatch], levels: int) -> Iterator[tuple]:
    for (group, block), rows in _blocks(batches):
        members = list(rows)
        leaves, size = [m[4].hex().encode() for m in members], members[0][3]
        height = _height(len(leaves), size, levels)
        nodes = rise(leaves, height)
        root = _hash(*nodes[height, 0]) if height else leaves[0]
        yield group, block, -(-size // FAN**levels), bytes.fromhex(root.decode())


def _block_messages(batches: Iterable[pa.RecordBatch], levels: int) -> Iterator[tuple]:
    """From a block's members and the message to its root, the messages to the members."""
    for (group, _), rows in _blocks(batches):
        message = next(rows)
        members = list(rows)
        leaves = [m[4].hex().encode() for m in members]
        height = _height(len(leaves), members[0][3], levels)
        for member, proof in zip(members, fall(rise(leaves, height), height, _linked(message[7])), strict=True):
            yield group, member[2], message[5], message[6], _flat(proof)


def _proof_rows(batches: Iterable[pa.RecordBatch], levels: int, with_proofs: bool) -> Iterator[tuple]:
    for _, rows in _blocks(batches):
        message = next(rows)
        subroot, root = message[5].hex(), message[6].hex()
        members = list(rows)
        leaves = [m[4].hex().encode() for m in members]
        height = _height(len(leaves), members[0][3], levels)
        for member, leaf, proof in zip(members, leaves, fall(rise(leaves, height), height, _linked(message[7])), strict=True):
            flat = _flat(proof)
            folded = fold(leaf if member[9] is None else member[9].hex().encode(), proof).decode()
            yield member[8], member[2], leaf.decode(), subroot, root, hashlib.sha256(b"".join(flat)).hexdigest(), folded, flat if with_proofs else None


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``place`` from 0 within ``group`` by ``order``, and ``group_size``; no group is gathered in one task.

    Rows are dealt out and sorted by range; places are counted in a partition and shifted by the totals of those before.
    """
    sort = [F.col("group").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    slots = cut(rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("slot", F.monotonically_increasing_id()))
    part = F.shiftright("slot", 33)
    parts = slots.groupBy(F.col("group").alias("in_group"), part.alias("part")).agg(F.min("slot").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("in_group")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("in_group", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("group_size"))
    joined = slots.withColumn("own_part", part).join(starts, F.col("group").eqNullSafe(F.col("in_group")) & (F.col("own_part") == F.col("part")))
    return joined.withColumn("place", F.col("slot") + F.col("shift")).drop("slot", "own_part", "in_group", "part", "shift")


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks whole and in order within tasks; a message to a block (no place) comes before its members."""
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", F.col("place").asc_nulls_first())


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / FAN**levels).cast("long").alias("block")


def _climb(items: DataFrame, levels: int) -> list[DataFrame]:
    """Items of every round up to one a group: the places of a block become one item of the next round."""
    rounds = [items]
    while True:
        dealt = _dealt(rounds[-1].select("group", _block(levels), "place", "group_size", "digest"))
        rounds.append(cut(dealt.mapInArrow(_by_task(partial(_block_roots, levels=levels), _ITEM), _ITEM.replace("long", "bigint"))))
        if rounds[-1].filter("group_size > 1").isEmpty():
            return rounds


def _descend(rounds: list[DataFrame], messages: DataFrame, levels: int) -> DataFrame:
    """Messages to the items of the first round, from those to the last; ``messages`` go to places of the last round."""
    for items in reversed(rounds):
        messages = cut(_delivered(items, messages, levels).mapInArrow(_by_task(partial(_block_messages, levels=levels), _MESSAGE), _MESSAGE.replace("long", "bigint")))
    return messages


def _delivered(items: DataFrame, messages: DataFrame, levels: int, *carried: str) -> DataFrame:
    """The members of each block behind the message to its root."""
    sent = messages.select("group", F.col("place").alias("block"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("group_size"), F.lit(None).cast("binary").alias("digest"), "subroot", "root", "proof")
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("subroot", "binary"), ("root", "binary"), ("proof", "array<binary>"))]
    members = items.select("group", _block(levels), "place", "group_size", "digest", *empty, *carried)
    for name in carried:
        sent = sent.withColumn(name, F.lit(None).cast(members.schema[name].dataType))
    return _dealt(members.unionAll(sent))


def manifest(leaves: DataFrame, with_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """Per leaf ``id``, ``place``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, and ``proof`` if asked for.

    ``leaves`` holds ``id`` (long), ``group`` (string), ``digest`` (binary, see ``leaf_digest``) and ``presented`` (binary):
    the digest that is folded with the proof in place of the leaf's own, null for the own. Leaves of a group ascend by id,
    nulls first, equal ids by digest; groups ascend bytewise, null first, and an empty group name is a group of its own.
    ``proof`` lists the digests left and right of the way up, level by level; a round climbs ``levels`` of them. Repeated rows are leaves of their own. An
    empty table gives no rows; other columns are not read. Only digests are shuffled, never the rows they stand for.
    """
    items = cut(numbered(cut(leaves.select("id", "group", "digest", "presented")), "id", "digest"))
    rounds = _climb(items, levels)
    heads = rounds[-1].select(F.lit("").alias("group"), F.struct(F.col("group").alias("name")).alias("source"), F.col("digest"))
    groups = cut(numbered(heads, "source"))
    group_rounds = _climb(groups, levels)
    empty_proof = F.array().cast("array<binary>").alias("proof")
    top = group_rounds[-1].select("group", "place", F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"), empty_proof)
    to_groups = _descend(group_rounds[:-1], top, levels)
    named = groups.select(F.col("place").alias("at"), F.col("source.name").alias("name"), F.col("digest").alias("own"))
    to_heads = to_groups.join(named, F.col("place") == F.col("at")).select(F.col("name").alias("group"), F.lit(0).cast("long").alias("place"), F.col("own").alias("subroot"), "root", "proof")
    to_blocks = _descend(rounds[1:-1], to_heads, levels)
    out = "id long, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, proof array<binary>"
    work = partial(_proof_rows, levels=levels, with_proofs=with_proofs)
    rows = _delivered(items, to_blocks, levels, "id", "presented").mapInArrow(_by_task(work, out), out.replace("long", "bigint"))
    return rows if with_proofs else rows.drop("proof")
