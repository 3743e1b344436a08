"""Personal data and the terms that give it away.

Values of four kinds are found by their form. A value is a protected entity; the terms of the documents that
mention it are weighed by pointwise mutual information over the whole corpus: a term that hardly ever occurs
without the entity reveals it, and is removed or generalised as well, wherever it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema, cut

#: Kinds in the order of the contract; spans of disclosing terms come last.
KINDS = ("email", "ip", "card", "phone", "term")

#: Terms on either side of a mention that make its surroundings, and how far to look for them (characters).
NEAR_TERMS = 8
NEAR_CHARS = 200
#: A term must occur with an entity in so many different texts, or next to it in so many different surroundings;
#: copies of one text count once. With less, every rare word of a text would reveal what the text mentions.
LEAST_CONTEXTS = 3
#: So many disclosing terms are sent to all workers; more are joined with the terms of the texts.
BROADCAST_TERMS = 500_000
#: Share of the entity's information that a term must give to be generalised, or removed.
GENERALISE, REMOVE = 0.6, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A number that starts inside a run of digits fails wherever the run's start does, so only starts are tried.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part and on over the domain: the leftmost matches, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in order: leftmost, non-overlapping per kind; failing matches are dropped."""
    out = [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.groups()):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def near_terms(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of the terms next to a mention, without those inside personal data or cut by the reach."""
    low, high = max(0, start - NEAR_CHARS), min(len(text), end + NEAR_CHARS)
    left = [m.span() for m in _TERM.finditer(text, low, start) if m.start() > low or low == 0][-NEAR_TERMS:]
    right = [m.span() for m in _TERM.finditer(text, end, high) if m.end() < high or high == len(text)][:NEAR_TERMS]
    return [(a, b) for a, b in left + right if not any(s < b and a < e for s, _, e in spans)]


def _outside(spans: list[tuple[int, int, int]], found: Iterator[re.Match]) -> Iterator[re.Match]:
    """Matches that do not overlap any of the spans; both come in order of their starts."""
    at, end = 0, 0
    for m in found:
        while at < len(spans) and spans[at][0] < m.end():
            end = max(end, spans[at][2])
            at += 1
        if end <= m.start():
            yield m


_FOUND = "entities array<long>, near_entities array<long>, contexts array<long>, terms array<string>, digest long, held array<string>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(_FOUND)
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text)
            if not spans:
                continue
            entities, near = set(), set()
            for start, kind, end in spans:
                value = text[start:end].lower() if kind == 0 else re.sub("[^0-9.]" if kind == 1 else "[^0-9]", "", text[start:end])
                entity = xxhash.xxh3_64_intdigest(f"{kind}:{value}") >> 1
                entities.add(entity)
                terms = [text[a:b].lower() for a, b in near_terms(text, start, end, spans)]
                context = xxhash.xxh3_64_intdigest(" ".join(terms)) >> 1
                near.update((entity, context, term) for term in terms)
            held = {m[0].lower() for m in _outside(spans, _TERM.finditer(text))}
            digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
            rows.append((sorted(entities), *(zip(*near, strict=True) if near else ((),) * 3), digest, sorted(held)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def find_mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One stored row per document with personal data: its entities, the terms around each mention, and all its terms."""
    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_find, _FOUND.replace("long", "bigint"))
    return cut(found.withColumn("row", F.monotonically_increasing_id()))


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """``entity``, ``term``, ``disclosure``: the share of an entity's information that a term gives.

    With n documents, of which n_e mention the entity, n_t hold the term and n_et do both:
    log(n n_et / (n_e n_t)) / log(n / n_e), 1 where the term never occurs elsewhere. Terms of at least
    ``LEAST_CONTEXTS`` different texts or surroundings and ``GENERALISE`` disclosure are returned. Only documents
    of entities that can have such terms are paired with their terms.
    """
    mentions = found.select("row", "digest", F.explode("entities").alias("entity"))
    near = found.select(F.explode(F.arrays_zip("near_entities", "contexts", "terms")).alias("n"))
    near = near.select(F.col("n.near_entities").alias("entity"), F.col("n.contexts").alias("context"), F.col("n.terms").alias("term"))
    windows = near.groupBy("entity", "term").agg(F.count_distinct("context").alias("n_windows")).filter(F.col("n_windows") >= LEAST_CONTEXTS)
    known = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct("digest").alias("n_texts"))
    known = known.join(windows.select("entity", F.lit(True).alias("often")).distinct(), "entity", "left")
    known = known.filter((F.col("n_texts") >= LEAST_CONTEXTS) | F.col("often")).select("entity", "n_entity")
    chosen = cut(mentions.join(known, "entity"))
    held = found.join(chosen.select("row").distinct(), "row", "left_semi").select("row", F.explode("held").alias("term"))
    together = chosen.join(held, "row").groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both"), F.count_distinct("digest").alias("n_texts"))
    together = together.join(windows, ["entity", "term"], "left").filter((F.col("n_texts") >= LEAST_CONTEXTS) | F.col("n_windows").isNotNull())
    lowered = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")
    words = docs.select(F.explode(F.array_distinct(lowered)).alias("term")).filter(F.length("term") >= 3)
    frequencies = words.groupBy("term").agg(F.count("*").alias("n_term"))
    weighed = together.join(frequencies, "term").withColumn("n", F.lit(docs.count()))
    information = F.ln(F.col("n") / F.col("n_entity"))
    shared = F.ln(F.col("n") * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    share = F.when(information > 0, shared / information).otherwise(0.0)
    return weighed.select("entity", "term", share.alias("disclosure")).filter(F.col("disclosure") >= GENERALISE)


_SPANS = "doc_id long, starts array<long>, kinds array<long>, ends array<long>, disclosures array<double>"


def _spans(shared: Broadcast):
    """Base spans and the spans of disclosing terms: those sent to all workers, and those beside a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_SPANS)
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for text, terms, disclosures in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                base = base_spans(text)
                spans: list[tuple] = [(*s, None) for s in base]
                revealing = dict(zip(terms, disclosures, strict=True)) if terms else shared.value
                if revealing:
                    for m in _outside(base, _TERM.finditer(text)):
                        if disclosure := revealing.get(m[0].lower()):
                            spans.append((m.start(), len(KINDS) - 1, m.end(), disclosure))
                    spans.sort(key=lambda s: s[:3])
                for column, values in zip(columns, zip(*spans, strict=True) if spans else ((),) * 4, strict=True):
                    column.append(list(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id``, counts per kind, ``base`` and ``spans`` (arrays of start, kind, end, disclosure).

    Null text counts as empty, without spans; null ids, repeated rows and ties stay rows of their own; an
    empty table gives no rows; only the two named columns are read. Counts and frequencies cover every
    document, and a disclosing term is found in every text. Texts are read three times and, up to
    ``BROADCAST_TERMS`` disclosing terms, never shuffled.
    """
    revealing = disclosing_terms(docs, find_mentions(docs, text_col), text_col)
    revealing = cut(revealing.groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent: dict[str, float] = {}
    if revealing.count() <= BROADCAST_TERMS:
        sent = {r["term"]: r["disclosure"] for r in revealing.toLocalIterator()}
        rows = slim.select("doc_id", "text", F.lit(None).cast("array<string>").alias("terms"), F.lit(None).cast("array<double>").alias("disclosures"))
    else:
        stored = cut(slim.withColumn("row", F.monotonically_increasing_id()))
        held = stored.select("row", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term")).join(revealing, "term")
        held = held.groupBy("row").agg(F.collect_list(F.struct("term", "disclosure")).alias("held"))
        rows = stored.join(held, "row", "left").select("doc_id", "text", F.col("held.term").alias("terms"), F.col("held.disclosure").alias("disclosures"))
    found = rows.mapInArrow(_spans(docs.sparkSession.sparkContext.broadcast(sent)), _SPANS.replace("long", "bigint"))
    zipped = F.arrays_zip("starts", "kinds", "ends", "disclosures")
    spans = F.transform(zipped, lambda s: F.struct(s["starts"].alias("start"), s["kinds"].alias("kind"), s["ends"].alias("end"), s["disclosures"].alias("disclosure")))
    counts = [F.size(F.array_remove("kinds", k)) for k in range(len(KINDS) - 1)]
    counts = [(F.size("kinds") - n).cast("long").alias(f"n_{name}") for n, name in zip(counts, KINDS, strict=False)]
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return found.select("doc_id", "kinds", spans.alias("spans")).select("doc_id", *counts, base.alias("base"), "spans")


def spelled(spans) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text, spans) -> Column:
    """A text with its spans replaced: values and removed terms by their kind, generalised terms by a general word.

    Overlapping spans give way to the one that starts first.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        word = F.when(s["disclosure"] < REMOVE, F.lit("[word]")).when(s["kind"] == len(KINDS) - 1, F.lit("")).otherwise(F.get(names, s["kind"].cast("int")))
        out = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), word)
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(out.alias("out"), s["end"].alias("at")))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
