"""Operators that work document by document: personal data, token counts, quality rules, toxicity."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratapanel.llm import pii, quality_rules, token_counts, toxicity
from stratapanel.llm.common import by_bytes
from stratapanel.llm.token_ids import WordEncoder

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [None, "", " \t\n", "a", "é" * 40, "word " * 300, "x" * 200_000, "one two three\n\none two three\n" * 30, "tab\there\x0bthere\x1fthen end ́mark"]


def frame(spark, texts, start=1):
    """Documents with columns whose names clash with those of results; a null id and a repeated row at the end."""
    rows = [(start + k, t, 1, "n") for k, t in enumerate(texts)] + [(None, "null id here", 2, "m"), (start, texts[0] if texts else None, 3, "m")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, bits string")


# Personal data


def plain_spans(text):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.+-0129 ()é", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [(s, pii.KINDS[k], e) for s, k, e in pii.base_spans(text)] == plain_spans(text)


def test_base_spans_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_terms_that_reveal_an_entity_are_added(spark):
    random.seed(3)
    fill = [f"{a}{b}" for a in ("common", "plain", "usual", "normal") for b in ("word", "text", "thing", "matter")]
    texts = [" ".join(random.choices(fill, k=30)) for _ in range(300)]
    texts += [f"{' '.join(random.choices(fill, k=9))} Zorblatt {random.choice(fill)} zo@ex.org {' '.join(random.choices(fill, k=9))}" for _ in range(6)]
    docs = frame(spark, texts)
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(texts) + 2
    hit = [r for r in rows if r.n_email]
    for r in hit:
        text = texts[r.doc_id - 1]
        assert [text[s.start : s.end] for s in r.spans if s.kind == 4] == ["Zorblatt"]
        assert [s.kind for s in r.base] == [0]
    assert len(hit) == 6 and all(not r.spans for r in rows if not r.n_email)
    out = pii.find_personal_data(docs).filter("n_email > 0").join(docs.select("doc_id", "text"), "doc_id")
    cleaned = [r[0] for r in out.select(pii.sanitised(F.col("text"), F.col("spans"))).collect()]
    assert all("Zorblatt" not in t and "zo@ex.org" not in t and "[email]" in t for t in cleaned)


@pytest.mark.parametrize("most", [pii.BROADCAST_TERMS, 0])
def test_revealing_terms_are_found_everywhere(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", most)
    random.seed(4)
    fill = [f"{a}{b}" for a in ("common", "plain", "usual", "normal") for b in ("word", "text", "thing", "matter")]
    some = lambda n: " ".join(random.choices(fill, k=n))
    texts = [some(40) for _ in range(300)]
    texts += [f"{some(9)} zo@ex.org {some(40)} Zorblatt {some(5)} zorblatt, {some(3)}" for _ in range(6)] + [f"{some(20)} Zorblatt {some(9)}"]
    rows = pii.find_personal_data(frame(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        terms = [texts[r.doc_id - 1][s.start : s.end] for s in r.spans if s.kind == 4] if r.doc_id else []
        assert terms == (["Zorblatt", "zorblatt"] if r.n_email else ["Zorblatt"] if r.doc_id == len(texts) else [])


def test_copies_of_one_text_reveal_nothing(spark):
    docs = frame(spark, ["write to Quillon at q@ex.org soon"] * 20 + ["another text of words"] * 30)
    assert all(all(s.kind != 4 for s in r.spans) for r in pii.find_personal_data(docs).collect())


def test_personal_data_of_awkward_texts(spark):
    rows = pii.find_personal_data(frame(spark, [*AWKWARD, "a@b.c 1.2.3.4, 4111-1111-1111-1111, +1 (212) 555-0100"])).collect()
    assert len(rows) == len(AWKWARD) + 3
    full = next(r for r in rows if r.doc_id == len(AWKWARD) + 1)
    assert (full.n_email, full.n_ip, full.n_card, full.n_phone) == (1, 1, 1, 1)
    assert pii.find_personal_data(frame(spark, []).limit(0)).count() == 0


# Token counts


def test_batches_are_measured_in_bytes():
    assert [len(b) for b in by_bytes(["語" * 10] * 6, 60)] == [2, 2, 2] and [len(b) for b in by_bytes(["a" * 10] * 12, 60)] == [6, 6]
    assert list(by_bytes(["é" * 40, "x"], 60)) == [["é" * 40], ["x"]]


@pytest.mark.parametrize("most", [1, 7, 50])
@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="ab  \n\t.'é9<|endoftxt>", max_size=200))
def test_pieces_have_the_tokens_of_the_text(most, text):
    encode = token_counts.tokenizer(BYTE_BPE).encode
    whole = encode(text, add_special_tokens=False).ids
    cut = token_counts.pieces(text, most)
    assert "".join(cut) == text and [i for p in cut for i in encode(p, add_special_tokens=False).ids] == whole


def test_token_counts(spark):
    texts = [*AWKWARD, "a <|endoftext|> b", " ".join(f"w{k}" for k in range(60_000))]
    rows = token_counts.count_tokens(frame(spark, texts), BYTE_BPE, 1024).collect()
    plain = Tokenizer.from_file(BYTE_BPE)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id:
            text = texts[r.doc_id - 1] or ""
            n = len(plain.encode(text, add_special_tokens=False))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert token_counts.count_tokens(frame(spark, []).limit(0), BYTE_BPE, 1024).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÀé́ΣςI İ\n\t  \x1f'’s9!<|endoftxsar>", max_size=60), max_size=4))
def test_words_have_the_ids_of_the_text(texts):
    encoder, plain = WordEncoder(WORD_BPE), token_counts.tokenizer(WORD_BPE)
    assert [ids.tolist() for ids in encoder(texts, 2)] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abzAZÀéÿßØ \n'sStTrReEvVmMlLdD019!<|>_-.,`~@[{^\\]}*\"#$%&()+/:;=?", max_size=80), max_size=4))
def test_parts_have_the_ids_of_the_text(texts):
    encoder, plain = WordEncoder(WORD_BPE), token_counts.tokenizer(WORD_BPE)
    assert encoder.by_parts and not WordEncoder(BYTE_BPE).by_parts
    assert [ids.tolist() for ids in encoder(texts, 2)] == [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_plain_texts_meet_no_normalizer():
    encoder = WordEncoder(WORD_BPE)
    encoder.encode = None
    words = [f"Zq{k}É'Ll, {k}-x" for k in range(500)]
    found = encoder([" ".join(words).upper(), " ".join(words)], 2)
    assert found[0].tolist() == found[1].tolist() == token_counts.tokenizer(WORD_BPE).encode(" ".join(words), add_special_tokens=False).ids + [2]


# Quality rules


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_ledger_measures(spark):
    random.seed(5)
    texts = [*AWKWARD, *[" ".join(random.choices(["a", "b", "c|", "d#é"], k=k)) for k in range(0, 120, 3)], "a b a b a b", "a\n b\r\na\n\n b"]
    rows = quality_rules.ledger(frame(spark, texts).drop("n_words", "bits")).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r.doc_id - 1])
    assert quality_rules.ledger(frame(spark, []).limit(0)).count() == 0
    assert quality_rules.ledger(frame(spark, texts)).columns[1] == "n_words"  # clashing columns are not read


def test_verdicts_passing_and_ablations_agree(spark):
    good = " ".join(f"word{k}" for k in range(80))
    texts = [good, good + " " + "#$ " * 60, "short", "ha ha ha " * 40, "WORD!! " * 5 + good.upper().replace(" ", "!! "), None]
    docs = frame(spark, texts)
    entries = quality_rules.ledger(docs)
    kept = quality_rules.verdicts(entries, quality_rules.BASE, quality_rules.PRODUCTION)
    assert [r.doc_id for r in kept.filter("kept_2").collect()] == [1, 1]
    passed = quality_rules.passing(docs)
    assert passed.columns == docs.columns and [r.doc_id for r in passed.collect()] == [1, 1]
    found = {r["rule"]: r for r in quality_rules.ablations(entries, quality_rules.PRODUCTION).collect()}
    assert all(r.n_rows == 8 and r.n_kept == 2 for r in found.values())
    assert found["symbols"].n_kept_more_without == 1 and found["few_words"].n_failed == 3


# Toxicity


def labelled(spark, n=1500):
    random.seed(9)
    insults, groups, fill = ["zerg", "plork"], ["northers", "southers"], [f"word{k}" for k in range(400)]
    rows, marks = [], []
    for k in range(n):
        words = random.choices(fill, k=random.randint(5, 60))
        kind = random.random()
        if kind < 0.3:
            words += [random.choice(insults), random.choice(groups)]
        elif kind < 0.5:
            words.append(random.choice(insults))
        elif kind < 0.7:
            words.append(random.choice(groups))
        random.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, int(kind < 0.3)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_pairs_of_terms_are_learnt(spark):
    docs, marks = labelled(spark)
    rows = toxicity.score_toxicity(spark, docs, marks).join(marks, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 400 < len(held) < 600 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in held) / len(held)
    assert right > 0.95  # insult and group alone are each clean: no sum of weights parts them as well


def test_toxicity_of_awkward_rows(spark):
    docs, marks = labelled(spark, 60)
    rows = toxicity.score_toxicity(spark, frame(spark, AWKWARD), marks.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == len(AWKWARD) + 2 and all(0 <= r.score <= 1 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    none = toxicity.score_toxicity(spark, docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.score_toxicity(spark, docs.limit(0), marks).count() == 0
    assert toxicity.score_toxicity(spark, docs, marks.withColumn("toxic", F.lit(None).cast("int"))).count() == 60


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, marks = labelled(spark, 300)
    turned = marks.withColumn("toxic", F.when(toxicity.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(spark, docs, m).collect()) for m in (marks, turned))
    assert a == b


def test_hash_of_no_spans():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
