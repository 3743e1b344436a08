"""Operators over the whole corpus: mixing, decontamination, near-duplicates, and the pipeline."""

import os
import random
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratapanel.llm import common, decontaminate, mixing, near_duplicates, queries
from stratapanel.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql_on_awkward_rows(spark, name, tmp_path):
    random.seed(1)
    texts = [None, "", " \n", "a", "b " * 80, *[" ".join(random.choices("ab#", k=k)) for k in range(1, 200, 5)], "x" * 50_000]
    rows = [(k, t, random.choice([None, "", "é", "s1", "S1"]), "x", 1.0, random.choice([None, "", "de"]), random.choice([None, k])) for k, t in enumerate(texts)]
    rows += [(None, "null id", "s1", "y", 2.0, "", 1), *[(3, "a", "s1", "y", 2.0, "fr", None)] * 2]
    for n, part in enumerate((rows, rows[:0], rows[:1])):
        path = f"{tmp_path}/{n}"
        spark.createDataFrame(part, "doc_id long, text string, source string, bits string, target double, lang string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
        mine = queries.QUERIES[name](spark, path).toPandas()
        db = duckdb.connect()
        db.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
        theirs = db.execute(queries.ORACLES[name]).df()
        columns = sorted(mine.columns)
        assert columns == sorted(theirs.columns)
        key = lambda f: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False))
        assert [tuple("None" if v in ("nan", "<NA>") else v for v in r) for r in key(mine)] == [tuple("None" if v in ("nan", "<NA>") else v for v in r) for r in key(theirs)]


# Mixing


def test_targets_are_filled_by_weight_up_to_three_epochs(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 10), (None, 1000)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert found["c"] == 30 and abs(sum(found.values()) - 3010) < 1e-9
    assert abs(found["b"] - 2 * found["a"]) < 1e-9 and abs(found[None] - found["a"]) < 1e-9


def test_mix_comes_near_its_targets_whatever_the_partitions(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents", "doc_id", "text", "source").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    mixed = mixing.mix_sources(docs).cache()
    for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r.taken - r.target) <= r.most and r.over <= 0
    again = mixing.mix_sources(docs.repartition(13))
    assert mixed.exceptAll(again).count() == 0 and again.exceptAll(mixed).count() == 0
    partial = mixed.filter((F.col("copies") > 0) & (F.col("copies") < 3)).groupBy("source").agg((F.max("copies") - F.min("copies")).alias("d")).filter("d > 1")
    assert partial.count() == 0  # whole epochs come first


def test_quality_decides_who_is_sampled(spark):
    good, bad = " ".join(["word"] * 60), " ".join(["word#$%&"] * 60)
    docs = spark.createDataFrame([(k, good if k % 2 else bad, f"s{k % 3 // 2}") for k in range(4000)], "doc_id long, text string, source string")
    taken = {r["good"]: r["share"] for r in mixing.mix_sources(docs).filter("copies < 2 and source = 's0'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg("copies").alias("share")).collect()}
    assert taken[1] > taken[0] + 0.1


# Decontamination


def words(n, seed):
    r = random.Random(seed)
    return [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 400)}" for _ in range(n)]


def leaks_by_hand(text, item):
    """Covered shares of question and answer, from all shingles of the text."""
    tokens, own = decontaminate.normalised(text or ""), decontaminate.normalised(item or "")
    width = min(5, len(own))
    have = {tuple(tokens[k : k + width]) for k in range(len(tokens) - width + 1)}
    covered = [False] * len(own)
    for k in range(len(own) - width + 1):
        if tuple(own[k : k + width]) in have:
            covered[k : k + width] = [True] * width
    answer = len(decontaminate.normalised(decontaminate._SENTENCE.split((item or "").strip())[-1]))
    split = len(own) - answer if answer < len(own) else 0
    parts = [covered[:split] or covered[split:], covered[split:]]
    return bool(own) and all(sum(p) >= 0.75 * len(p) for p in parts)


def test_leaks_equal_brute_force(spark):
    items = [(k, " ".join(words(n, k)) + "? " + " ".join(words(n // 3 + 1, 50 + k)).capitalize() + ".") for k, n in enumerate([3, 6, 12, 30, 60, 100, 200])]
    items += [(7, None), (8, ""), (9, "!"), (3, items[3][1])]
    docs = []
    for k in range(120):
        body = words(random.Random(k).randint(0, 700), 1000 + k)
        if k % 4:
            own = items[k % 7][1].split()
            if k % 4 == 2:
                for at in range(0, len(own), 13):
                    own[at] = "changed"
            if k % 4 == 3:
                own = own[: len(own) * 2 // 3]
            at = random.Random(k + 7).randint(0, len(body))
            body[at:at] = [w.upper() for w in own]
        docs.append((k, " ".join(body)))
    docs += [(None, items[4][1]), (500, None), (501, ""), (0, docs[1][1]), (1, docs[1][1])]
    frame = spark.createDataFrame([(*d, 9, "c") for d in docs], "doc_id long, text string, item_id int, score string")
    bench = spark.createDataFrame([(*i, "c") for i in items], "item_id long, text string, doc_id string")
    found = sorted((str(r.doc_id), r.item_id) for r in decontaminate.leaks(spark, frame, bench).collect())
    assert found == sorted((str(d), i) for d, t in docs for i, item in items if leaks_by_hand(t, item))
    flagged = frame.filter(decontaminate.contaminated(spark, bench, F.col("text")))
    assert sorted(str(r.doc_id) for r in flagged.collect()) == sorted(str(d) for d, t in docs if any(leaks_by_hand(t, i) for _, i in items))
    assert decontaminate.leaks(spark, frame, bench.limit(0)).count() == 0 and decontaminate.leaks(spark, frame.limit(0), bench).count() == 0


@pytest.mark.parametrize(("item", "text", "leaked"), [
    ("{q}? Paris.", "{b} {q}? Answer: Paris. {b}", True), ("{q}? Paris.", "{b} {q}? Paris. {b}", True), ("{q}? New Old Paris.", "{b} {q}? It is New Old Paris {b}", True),
    ("{q}? Paris.", "{b} {e}? Answer: Paris. {b}", True), ("{q}? Paris.", "{b} {q}? {b} Paris {b}", False), ("{q}? Paris.", "{b} Paris {q}? {b}", False),
    ("{q}? New Old Paris.", "{b} {q}? Answer: Old Paris {b}", False), ("{q} paris {q} end? Paris.", "{b} {q} paris {q} end? {b}", False),
    ("Where now? {q}.", "{b} Where now? Answer: {q}. {b}", True), ("Where now? {q}.", "Where now? {b} {q}. {b}", False),
    ("Zorb quill where? Paris.", "{b} zorb quill where? Answer: Paris. {b}", True), ("Zorb quill where? Paris.", "{b} zorb quill where? {b}", False),
])
def test_short_parts_are_found_beside_the_other(item, text, leaked):
    q, b = words(12, 900), " ".join(words(60, 901))
    e = " ".join([*q[:-1], "changed"])
    fill = lambda x: x.format(q=" ".join(q), b=b, e=e)
    index = decontaminate.ItemIndex([(1, fill(item)), *((k, " ".join(words(20, 902 + k))) for k in range(2, 30))])
    assert [i for i, *_ in next(index.matches([fill(text)]))] == [1] * leaked


def test_search_finds_all_above_the_threshold_and_small_indexes_agree(spark):
    items = [(k, " ".join(words(random.Random(k).randint(5, 90), k % 40))) for k in range(200)]
    index = decontaminate.ItemIndex(items)
    for k in range(60):
        passage = set(index.term[w] for w in items[k][1].split()[:70] + words(40, 900 + k) if w in index.term)
        scores = {}
        for t in passage:
            for entry, impact in zip(*index.lists[t][:2], strict=True):
                scores[entry] = scores.get(entry, 0) + impact
        for threshold in (0.2, 0.5):
            expected = sorted(e for e, s in scores.items() if s >= threshold)
            assert sorted(e for e, _ in index.search(passage, list(range(index.n_blocks)), threshold)) == expected
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert sum(len(i.items) for i in decontaminate.item_indexes(frame, chars=500)) == 200


# Near-duplicates


def components_by_hand(texts):
    sets = {k: frozenset(near_duplicates.shingle_set(t).tolist()) for k, t in texts}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {k: (len(sets[k]), root(k)) for k in sets}


def family(n, size, edits, seed):
    r = random.Random(seed)
    base = words(size, seed)
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(size)] = f"e{r.randint(0, 9999)}"
        out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    texts = [None, "", " ", "a", "A", "a b", "A  b", "b a", "ä b", "Ä b", "x " * 500]
    texts += family(40, 120, 10, 1) + family(15, 40, 3, 2) + family(300, 100, 14, 3) + [" ".join(words(90, 5000 + k)) for k in range(60)]
    texts += [texts[20]] * 30 + [" ".join(words(60, 77)) + " " + " ".join(words(20, 6000 + k)) for k in range(150)]
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows] + [(None, "q r s t u v", "c", 1), (None, "a", "c", 1)], "doc_id long, text string, class string, id int")
    expected = components_by_hand(rows)
    found = near_duplicates.near_duplicates(docs).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], r.doc_id == expected[r.doc_id][1])
    lonely = [r for r in found if r.doc_id is None]
    assert sorted((r.n_shingles, str(r.component_id), r.kept) for r in lonely) == [(1, str(expected[10][1]), False), (2, "None", True)]
    monkeypatch.setattr(near_duplicates, "STOP", 2.0)
    monkeypatch.setattr(near_duplicates, "NODE", 8)
    monkeypatch.setattr(near_duplicates, "GROUP", 16)
    again = near_duplicates.near_duplicates(docs.repartition(5))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0
    assert near_duplicates.near_duplicates(docs.filter("text is null")).count() == 1


def test_rows_of_large_families_grow_about_in_proportion(spark, monkeypatch):
    sort, rows = near_duplicates._sorted_by, []
    monkeypatch.setattr(near_duplicates, "_sorted_by", lambda df, key: rows.append(df.count()) or sort(df, key))
    grouped = []
    for n in (300, 600):
        rows.clear()
        texts = list(enumerate(family(n, 100, 10, 3)))
        found = near_duplicates.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components_by_hand(texts)
        grouped.append(sum(rows))
    assert grouped[1] <= 3 * grouped[0]


def test_signatures_are_looked_up_once_for_each_document(spark):
    entries = spark.createDataFrame([(node, k, 7) for k in range(50) for node in range(12)], "node long, id long, least long")
    signatures = spark.createDataFrame([(k, bytes([k])) for k in range(60)], "id long, signature binary")
    held = near_duplicates._with_signatures(entries, signatures).collect()
    assert sorted((r.id, r.signature, sorted(map(tuple, r.entries))) for r in held) == [(k, bytes([k]), [(node, 7) for node in range(12)]) for k in range(50)]


@pytest.mark.parametrize("limit", [500_000, 40])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(near_duplicates, "EDGES", limit)
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, 2000 + k) for k in range(300)]
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    found = near_duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {k for e in edges if e[0] != e[1] for k in e}
    assert {r.id: r.component for r in found} == {k: root(k) for k in linked} and len(found) == len(linked)


# Pipeline


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents", "*")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 or name == "mixing"
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r.doc_id for r in ids.collect()) == sorted(r.doc_id for r in docs.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, ids.collect()))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_awkward_documents(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", None, "s", 0), (2, "word " * 200, "en", None, 1), (2, "word " * 200, "en", None, 1), (3, "x" * 100_000, None, "s", 1)]
    for part in (rows, rows[:0]):
        out = stage[1](spark, spark.createDataFrame(part, schema), SF)
        assert out.columns and (out.count() > 0) == (bool(part) and stage[0] != "quality rules")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_pass_on_columns_of_any_name(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, taken_copies long, taken_id long, kept string, `a.b` int"
    text = " ".join(words(200, 1))
    docs = spark.createDataFrame([(k, f"{text} {k}", "en", "s", 1, 5, 6, "x", 7) for k in range(3)], schema)
    out = stage[1](spark, docs, SF)
    assert out.columns == docs.columns
    assert all(tuple(r)[2:] == ("en", "s", 1, 5, 6, "x", 7) for r in out.collect())


def test_copies_without_id_go(spark):
    text, other = " ".join(words(60, 1)), " ".join(words(60, 2))
    rows = [(4, text), (None, text), (None, text), (None, other), (None, other), (None, None), (None, " "), (7, "")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(4, text), (None, other), (None, None), (None, " "), (7, "")]))


def test_scratch_tables_go(spark):
    def folders():
        local = common.shared_folder(spark).removeprefix("file://")
        return {path for path, _, files in os.walk(local) if any(f.startswith("part-") for f in files)}

    before = folders()
    with common.scratch(spark) as keep:
        first = common.cut(spark.range(10))
        assert folders() > before
        kept = keep(first.filter("id > 6"))
    assert kept.count() == 3 and len(folders() - before) == 1
    with pytest.raises(ValueError), common.scratch(spark):
        common.cut(spark.range(5))
        raise ValueError
    assert len(folders() - before) == 1
