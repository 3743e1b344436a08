"""Token counts of texts under a public byte-level tokenizer; only lengths leave the Python workers."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema, by_bytes

#: Texts handed to the tokenizer at a time, in characters, and the longest piece of a long text.
BATCH_CHARS = 1 << 20
PIECE_CHARS = 1 << 16

#: One blank between two other characters. The pre-tokenizer never joins what stands before such a blank
#: with the blank or what follows, and no special token contains one.
_SAFE = re.compile(r"(?<=\S)[ \n](?=\S)")


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """Cuts a text before single blanks, into pieces of about ``most`` characters.

    The tokens of the pieces, one after another, are those of the text. Where no such blank follows,
    the rest stays one piece.
    """
    out, start = [], 0
    while len(text) - start > most:
        found = _SAFE.search(text, start + max(1, most - 1))
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in each Python worker and run on one thread there."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _loaded[path] = loaded
    return _loaded[path]


def token_lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, encoded in batches of even size."""
    encode = tokenizer(path).encode_batch_fast
    cut = [(row, piece) for row, text in enumerate(texts) for piece in (pieces(text) if len(text) > PIECE_CHARS else (text,))]
    counts, at = [0] * len(texts), 0
    for batch in by_bytes((piece for _, piece in cut), BATCH_CHARS):
        for encoding in encode(batch, add_special_tokens=False):
            counts[cut[at][0]] += len(encoding)
            at += 1
    return counts


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    Null and empty texts have no bytes and no tokens. Null ids and repeated rows stay as they are, an
    empty table gives no rows, other columns are not read. Long texts are cut where that cannot change
    their tokens. Nothing is shuffled, and a worker holds one Arrow batch of texts at a time.
    """
    schema = arrow_schema("doc_id long, n_bytes long, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = token_lengths(batch.column(2).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema=schema)

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
