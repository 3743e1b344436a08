"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema
from stratapanel.llm.factorization import FactorizationMachine, fit, probability

#: Terms are hashed into so many buckets. A term is a word or, to meet inflected forms, the beginning of one.
BUCKETS, PREFIXES = 1 << 18, (4, 5)
#: At most about so many labelled rows are fitted on, chosen by a hash of their id.
FIT_ROWS = 10_000
#: Rows of the fit in which a term must occur.
LEAST_ROWS = 5
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def term_buckets(text: str) -> np.ndarray:
    """Buckets of the distinct terms of a text; sorted, without repetition."""
    words = set(_WORD.findall(text.lower()))
    terms = words.union(*({f"^{w[:n]}" for w in words if len(w) > n} for n in PREFIXES))
    return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, terms), np.int64, len(terms)) & (BUCKETS - 1))


def is_held_out(id_col: str) -> Column:
    """Rows whose labels no fit may see: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of the rows to fit on: labelled, not held out, each text once, about ``limit`` by a hash of the id."""
    known = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id"))
    share = min(1.0, limit / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("doc_id long, label long, text long, terms array<long>")
        for batch in batches:
            texts = batch.column(2).to_pylist()
            marks = [xxhash.xxh3_64_intdigest(t) >> 1 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.int64()), pa.array([term_buckets(t) for t in texts], pa.list_(pa.int64()))], schema=schema)

    rows = docs.join(chosen, "doc_id").select("doc_id", F.col("label").cast("long"), "text")
    found = rows.mapInArrow(run, "doc_id bigint, label bigint, text bigint, terms array<bigint>").toArrow()
    frame = pd.DataFrame({"doc_id": found.column("doc_id").to_pandas(), "label": found.column("label").to_pandas(), "text": found.column("text").to_pandas(), "at": np.arange(found.num_rows)})
    frame = frame.sort_values(["doc_id", "text", "label"]).drop_duplicates(["text", "label"])
    terms = found.column("terms").combine_chunks()
    return [np.asarray(terms[k].values, np.int64) for k in frame["at"]], frame["label"].to_numpy(np.float64)


def fit_model(terms: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """Fits twice: first with strong shrinkage, which leaves few terms, then on these with little."""
    sizes = np.array([len(t) for t in terms], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *terms])
    keep = np.bincount(flat, minlength=BUCKETS) >= LEAST_ROWS
    model = None
    for settings in ({"epochs": 4, "rate": 0.15, "l1": 6e-3, "l1_factors": 5e-2}, {"epochs": 30, "rate": 0.4, "l1": 2e-4, "l1_factors": 5e-3}):
        owner = np.repeat(np.arange(len(sizes)), sizes)[keep[flat]]
        model = fit(flat[keep[flat]], np.bincount(owner, minlength=len(sizes)), labels, BUCKETS, **settings)
        keep = (model.weights != 0) | (np.abs(model.factors).sum(axis=1) > 0)
    return model


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per input row ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score of at least ``THRESHOLD``).

    Null and blank texts have no terms and get the score of none; null ids are not held out and never fitted on;
    rows with a null label are not fitted on; repeated rows are fitted on once and scored each. Without labels every
    score is 0.5; empty tables give no rows. Only the named columns are read. The fit is bounded by ``FIT_ROWS``,
    its model is of fixed size; every text is scored whole where it is read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
    model = fit_model(*fit_rows(slim, marked))
    used = np.flatnonzero((model.weights != 0) | (np.abs(model.factors).sum(axis=1) > 0))
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    shared = spark.sparkContext.broadcast((place, FactorizationMachine(model.bias, model.weights[used], model.factors[used])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, small = shared.value
        for batch in batches:
            found = [place[term_buckets(text)] for text in batch.column(1).to_pylist()]
            found = [t[t >= 0] for t in found]
            odds = small.log_odds(np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(t) for t in found], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probability(odds), pa.float64())], schema=arrow_schema("doc_id long, score double"))

    scored = slim.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
