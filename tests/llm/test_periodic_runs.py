"""Runs of repeated words against all periods of all stretches, one by one."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stratapanel.llm import periodic_runs, queries
from stratapanel.llm.sequence_index import FactorRanks, WaveletTree

SF = "/root/testdata/sf0.001"


def runs_by_hand(words, least=24):
    found = {}
    for period in range(1, len(words) // 3 + 1):
        start = 0
        while start + period < len(words):
            end = start + period
            while end < len(words) and words[end] == words[end - period]:
                end += 1
            if end - start >= max(least, 3 * period):
                found.setdefault((start, end - start), period)
            start = max(start + 1, end - period + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed_by_hand(words, found):
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def sequences(seed):
    """Random words over few letters, powers, powers with an error, and runs that meet."""
    rnd = random.Random(seed)
    for kind in range(400):
        unit = [rnd.randint(0, 1 + kind % 3) for _ in range(rnd.randint(1, 40))]
        words = (unit * 40)[: rnd.randint(1, 250)]
        if kind % 4 == 1:
            words = [rnd.randint(0, 1) for _ in range(rnd.randint(1, 200))]
        if kind % 4 == 2:  # blocks that are periodic themselves inside a longer period
            v = rnd.randint(1, 3)
            words = (([0] * v + [1]) * rnd.randint(1, 5) + ([0] * (v + 1) + [1]) * rnd.randint(1, 5)) * 8
        if kind % 4 == 3:
            words[rnd.randrange(len(words))] = 9
            words += (words[-rnd.randint(1, len(words)) :] * 9)[:100]
        yield words


def test_runs_equal_those_of_all_periods():
    n = 0
    for words in sequences(11):
        for least in (5, 12, 24):
            expected = runs_by_hand(words, least)
            n += len(expected)
            assert [tuple(r) for r in periodic_runs.runs(np.array(words, np.int64), least).tolist()] == expected
    assert n > 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.data())
def test_index_answers(values, data):
    symbols = np.array(values, np.int64)
    factors = FactorRanks(symbols)
    assert factors.order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    tree = WaveletTree(factors.order)
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low + 1, len(values)))
    bound = data.draw(st.integers(0, 2 * len(values)))
    part = sorted(factors.order[low:high].tolist())
    one = lambda v: np.array([v])
    assert tree.below(one(low), one(high), one(bound))[0] == sum(v < bound for v in part)
    assert [int(tree.select(one(low), one(high), one(k))[0]) for k in range(len(part))] == part
    i, j = data.draw(st.permutations(range(len(values))))[:2] if len(values) > 1 else (0, 0)
    if i != j:
        forward = next(k for k in range(len(values) + 1) if max(i, j) + k >= len(values) or values[i + k] != values[j + k])
        backward = next(k for k in range(len(values) + 1) if min(i, j) - k <= 0 or values[i - k - 1] != values[j - k - 1])
        assert (factors.forward(one(i), one(j))[0], factors.backward(one(i), one(j))[0]) == (forward, backward)


def test_documents_are_indexed_together_and_apart(spark):
    rows = [(k, " ".join(map(str, words))) for k, words in enumerate(sequences(12))]
    rows += [(None, "a b " * 30), (5000, None), (5001, ""), (5002, " \n\t "), (5003, "x " * 24), (5003, "x " * 24), (5004, "é\xa0è " * 70), (5005, "so " * 20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'n' as runs", "1 as collapsed", "2 as starts")
    for words in (200, 200_000):
        got = sorted(((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(frame, together=words).collect()))
        expected = []
        for doc_id, text in rows:
            split = (text or "").replace("\xa0", "\x00").split()
            found = runs_by_hand(split) if doc_id != 5005 else [(0, 20_000, 1)]
            expected.append((doc_id is None, doc_id or 0, found, collapsed_by_hand(split, found).replace("\x00", "\xa0")))
        assert got == sorted(expected)
    assert periodic_runs.find_runs(frame.limit(0)).count() == 0


def test_query_equals_direct_enumeration(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for row in queries.op11_periodic_runs(spark, SF).collect():
        words, h = (texts[row.doc_id] or "").split(), zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1200:
            continue
        found = runs_by_hand(words)
        seen += len(found)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed_by_hand(words, found).encode()).hexdigest()
    assert seen > 20
