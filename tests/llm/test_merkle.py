"""The manifest against trees built level by level in one process."""

import hashlib
import random

from pyspark.sql import functions as F

from stratapanel.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, place):
    out = []
    for level in levels[:-1]:
        first = place // 16 * 16
        out += ["".join(level[first:place]), "".join(level[place + 1 : first + 16])]
        place //= 16
    return out


def by_hand(rows):
    """``rows`` of id, group, digest, presented; the expected rows in the order of groups and places."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees.append(levels_of([r[2] for r in groups[name]]))
    top = levels_of([t[-1][0] for t in trees])
    for k, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for place, (row_id, _, leaf, presented) in enumerate(groups[name]):
            proof = beside(tree, place) + beside(top, k)
            folded = presented or leaf
            for left, right in zip(proof[::2], proof[1::2], strict=True):
                folded = digest(left, folded, right)
            yield row_id, place, leaf, tree[-1][0], top[-1][0], digest(*proof), folded, tuple(proof)


def table_of(sizes, seed=0):
    rnd = random.Random(seed)
    rows = []
    for group, size in sizes.items():
        for k in range(size):
            leaf = digest(str((group, k)))
            rows.append((rnd.choice([None, rnd.randrange(10**6), k]), group, leaf, digest("other") if k % 7 == 0 else None))
    rows += rows[:3]  # repeated rows are leaves of their own
    rnd.shuffle(rows)
    return rows


def frame_of(spark, rows):
    frame = spark.createDataFrame(rows, "id long, group string, d string, p string")
    return frame.select("id", "group", F.unhex("d").alias("digest"), F.unhex("p").alias("presented"), F.lit(1).alias("place"), F.lit("x").alias("root"))


def found_in(frame, **options):
    columns = ("id", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root")
    return [tuple(r[c] for c in columns) + (tuple(bytes(b).decode() for b in r.proof),) for r in merkle.manifest(frame, with_proofs=True, **options).collect()]


def order(rows):
    return sorted(rows, key=str)


def test_every_proof_in_one_and_in_many_rounds(spark):
    sizes = {None: 33, "": 1, "a": 16, "b": 17, "big": 700, "é": 256, "z" * 40: 257, **{f"s{k}": 1 + k % 3 for k in range(40)}}
    rows = table_of(sizes)
    expected = order(by_hand(rows))
    for levels in (1, 2, 3):  # blocks of 16, 256 and 4,096 leaves
        assert order(found_in(frame_of(spark, rows), levels=levels)) == expected
    folded = {(r[4], r[6]) for r in expected}
    assert len({root for root, _ in folded}) == 1 and any(a != b for a, b in folded)


def test_one_leaf_one_group_and_no_rows(spark):
    single = table_of({"a": 1})[:1]
    assert found_in(frame_of(spark, single)) == list(by_hand(single))
    assert single[0][2] == next(by_hand(single))[4]
    assert order(found_in(frame_of(spark, table_of({"a": 5000})), levels=1)) == order(by_hand(table_of({"a": 5000})))
    assert merkle.manifest(frame_of(spark, single).limit(0)).count() == 0


def test_fields_are_spelled_with_their_length_in_bytes(spark):
    row = spark.sql("select 12 as a, 'é|' as b, cast(null as string) as c, '' as d").select(F.hex(merkle.leaf_digest(*[F.col(c) for c in "abcd"])))
    assert row.first()[0].lower() == digest("2:123:é|-0:")
