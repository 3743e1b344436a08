"""Repeated passages against the set of all windows."""

import random
import re

import numpy as np

from stratapanel.llm import relative_lz


def by_hand(rows):
    first = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for k in range(len(words) - 49 if doc_id is not None else 0):
            window = tuple(words[k : k + 50])
            first[window] = min(first.get(window, doc_id), doc_id)
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - 49 if doc_id is not None else 0):
            if first[tuple(words[k : k + 50])] < doc_id:
                gone |= set(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        yield str(doc_id), len(words), len(gone), kept


def corpus(seed):
    """Passages cut at random and joined with new words, so that windows over joints recur in some documents only."""
    rnd = random.Random(seed)
    new = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    pool = [new(rnd.choice([30, 55, 80, 200, 400])) for _ in range(12)] + [["so"] * 120, ["a", "b", "c"] * 40]
    joints = [pool[0] + pool[1][:40], new(20) + pool[2] + new(20)]
    rows = []
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(0, 5)):
            passage = rnd.choice(pool + joints)
            low = rnd.choice([0, 0, rnd.randrange(len(passage))])
            words += passage[low : rnd.choice([len(passage), rnd.randint(low, len(passage))])] + rnd.choice([[], [], new(rnd.randint(1, 60))])
        rows.append((rnd.randrange(400), " ".join(words)))
    rows += [(500 + k, text) for k, (_, text) in enumerate(rows[:30])] + rows[:5]  # copies and repeated rows
    rows += [(None, rows[0][1]), (None, rows[1][1]), (900, None), (901, ""), (902, " \n"), (903, "\xa0".join(new(60))), (904, "x " * 49)]
    return rows


def test_windows_of_smaller_documents_go(spark):
    rows = corpus(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as class", "1 as spans", "2 as start")
    expected = sorted(by_hand(rows))
    assert sum(r[2] > 0 for r in expected) > 60
    for together in (200_000, 300):  # the second indexes nearly every stretch by itself
        found = relative_lz.remove_repeats(frame, together=together).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found) == expected
    assert relative_lz.remove_repeats(frame.limit(0)).count() == 0


def test_windows_at_factor_boundaries(spark):
    """The reference holds the passage in another surrounding; the second and third document share one of their own."""
    passage, one, two = ([f"{c}{k}" for k in range(60)] for c in "pxy")
    rows = [(1, " ".join(passage)), (2, " ".join(one + passage + two)), (3, " ".join(one[30:] + passage + two[:10])), (4, " ".join(passage[:49]))]
    found = {r.doc_id: (r.n_removed, r.kept) for r in relative_lz.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (0, rows[0][1]), 2: (60, " ".join(one + two)), 3: (100, ""), 4: (0, rows[3][1])}


def test_many_documents_on_one_reference(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(k, f"{passage} " + " ".join(f"d{k}x{j}" for j in range(30))) for k in range(600)]
    found = relative_lz.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), together=2_000).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(k, 70 if k else 0) for k in range(600)]


def test_parse_takes_the_longest_factors():
    reference, query = np.arange(200), np.concatenate((np.arange(20, 100), np.arange(70, 140), [999], np.arange(60)))
    (longest,) = relative_lz.matches([[reference]], [(0, query)], 2000)
    assert longest[:3].tolist() == [80, 79, 78] and longest[150] == 0
    assert relative_lz.parse(longest) == [(0, 80), (80, 150), (151, 211)]
