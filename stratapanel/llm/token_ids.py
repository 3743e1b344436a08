"""Token ids of texts in compressed binary files, written in order of document and read back."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers.models import Model
from tokenizers.pre_tokenizers import ByteLevel

from stratapanel.llm.common import arrow_schema, by_bytes, cut
from stratapanel.llm.range_coder import BLOCK_IDS, decode_block, encode_block
from stratapanel.llm.token_counts import tokenizer

#: Characters of texts encoded at a time, words kept with their ids in a worker, bytes of text of a file.
BATCH_CHARS, CACHE_WORDS, FILE_BYTES = 1 << 20, 700_000, 24 << 20

#: File: magic; blocks, each after its length; a length of 0; the table of documents (ids, which of them are
#: null, numbers of token ids), deflated, after its length and checksum; magic.
_MAGIC = b"PIDS0001"
_LENGTH = struct.Struct("<I")
_TABLE = struct.Struct("<IIQ")


#: Texts of ASCII and Latin-1 letters alone, and the parts in which the tokenizers described below take them once in lower case.
_OTHER = re.compile(r"[^\n !-~À-ÖØ-öø-ÿ]")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[!-/:-@\[-`{-~]+")
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = ByteLevel(add_prefix_space=False, use_regex=False)
_SPELLED = {code: _BYTES.pre_tokenize_str(chr(code))[0][0] for code in range(0xDF, 0x100)}


class _PartIds(dict):
    """The ids of parts by the model of a tokenizer; a part not met before is encoded on the way."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.translate(_SPELLED)
        self[part] = ids = array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()
        return ids


#: By tokenizer, the ids of words and of parts met by this Python worker.
_known: dict[str, tuple[dict[str, bytes], _PartIds]] = {}


class WordEncoder:
    """Encodes texts word by word; the ids of the words met last are kept.

    Valid for tokenizers that drop white space and never join what it parts: a text's ids are then those of its
    words in turn. Words are cut at spaces and line feeds only, everything else is left to the tokenizer.

    Where the tokenizer's own description says that it lower-cases and then parts letters, digits and other characters,
    texts in which that is plain are cut into these parts, and its model encodes each new part: they are fewer than
    the words and pass no normalizer. Texts with other characters or special tokens go by words.
    """

    def __init__(self, path: str) -> None:
        loaded = tokenizer(path)
        self.encode = loaded.encode_batch_fast
        self.known, self.parts = _known.setdefault(path, ({}, _PartIds(loaded.model)))
        self.special = [token.content.lower() for token in loaded.get_added_tokens_decoder().values()]
        normalizer, splitter = (json.loads(x.__getstate__()) if x else {} for x in (loaded.normalizer, loaded.pre_tokenizer))
        first, *rest = splitter.get("pretokenizers") or [None]
        bytes_follow = [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in rest] == [("ByteLevel", False, False)]
        self.by_parts = normalizer.get("normalizers") == _NORMALIZER and first == _SPLIT and bytes_follow

    def _cut(self, text: str) -> list[str] | None:
        """The parts of a text in lower case; none if it must go by words."""
        if not self.by_parts or _OTHER.search(text):
            return None
        lower = text.lower()
        return None if any(token in lower for token in self.special) else _PARTS.findall(lower)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        known, fresh = self.known, set()
        split = [text.replace("\n", " ").split(" ") for text in texts]
        for words in split:
            fresh.update(filterfalse(known.__contains__, words))
        fresh = list(fresh)
        coded = [array("I", encoding.ids).tobytes() for encoding in self.encode(fresh, add_special_tokens=False)]
        known.update(zip(fresh, coded, strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def __call__(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text, and the end id after them."""
        before = len(self.known), len(self.parts)
        coded = [None if parts is None else b"".join(map(self.parts.__getitem__, parts)) for parts in map(self._cut, texts)]
        others = [text for text, ids in zip(texts, coded, strict=True) if ids is None]
        by_words = iter(self._by_words(others) if others else ())
        end = array("I", [end_id]).tobytes()
        out = [np.frombuffer((next(by_words) if ids is None else ids) + end, np.uint32) for ids in coded]
        for known, n in zip((self.known, self.parts), before, strict=True):
            for word in list(islice(known, n, None)) if len(known) > CACHE_WORDS else ():  # the first words met are the frequent ones
                del known[word]
        return out


class TokenFileWriter:
    """Writes one file: ids go into blocks as they come, the table of documents follows at the end."""

    def __init__(self, out: pa.NativeFile, vocabulary: int) -> None:
        self.out, self.vocabulary = out, vocabulary
        self.held: list[np.ndarray] = []
        self.size, self.doc_ids, self.lengths = 0, [], []
        out.write(_MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BLOCK_IDS:
            rest = np.concatenate(self.held)
            while len(rest) >= BLOCK_IDS:
                self._block(rest[:BLOCK_IDS])
                rest = rest[BLOCK_IDS:]
            self.held, self.size = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids, self.vocabulary)
        self.out.write(_LENGTH.pack(len(data)) + data)

    def close(self) -> None:
        if self.size:
            self._block(np.concatenate(self.held))
        null = np.array([i is None for i in self.doc_ids], np.uint8)
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        table = zlib.compress(ids.tobytes() + null.tobytes() + np.array(self.lengths, "<u8").tobytes(), 6)
        self.out.write(_LENGTH.pack(0) + _TABLE.pack(len(table), zlib.crc32(table), len(ids)) + table + _MAGIC)


def read_token_file(data: pa.NativeFile, path: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Documents of a file in order: id, ids before it in the file, token ids. Blocks are decoded as they are needed."""
    size = data.size()
    if size < 2 * len(_MAGIC) or data.read_at(len(_MAGIC), 0) != _MAGIC or data.read_at(len(_MAGIC), size - len(_MAGIC)) != _MAGIC:
        raise ValueError(f"{path}: not a whole file of token ids")
    blocks, at = [], len(_MAGIC)
    while length := _LENGTH.unpack(data.read_at(_LENGTH.size, at))[0]:
        blocks.append((at + _LENGTH.size, length))
        at += _LENGTH.size + length
    length, check, n = _TABLE.unpack(data.read_at(_TABLE.size, at + _LENGTH.size))
    table = data.read_at(length, at + _LENGTH.size + _TABLE.size)
    if zlib.crc32(table) != check:
        raise ValueError(f"{path}: the table of documents differs from its checksum")
    table = zlib.decompress(table)
    doc_ids = np.frombuffer(table, "<i8", n).tolist()
    null = np.frombuffer(table, np.uint8, n, 8 * n)
    lengths = np.frombuffer(table, "<u8", n, 9 * n).astype(np.int64).tolist()
    rest, before = np.zeros(0, np.uint32), 0
    turn = iter(blocks)
    for doc_id, is_null, wanted in zip(doc_ids, null, lengths, strict=True):
        parts, held = [rest], len(rest)
        while held < wanted:
            start, length = next(turn)
            parts.append(decode_block(data.read_at(length, start)))
            held += len(parts[-1])
        rest = np.concatenate(parts) if len(parts) > 1 else rest
        yield None if is_null else doc_id, before, rest[:wanted]
        rest, before = rest[wanted:], before + wanted
    if len(rest) or next(turn, None):
        raise ValueError(f"{path}: more ids than its documents have")


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents in ascending order of id; returns the stored manifest (``part, path, n_docs, n_ids, start``).

    Null text counts as empty, so it has the end id alone. Null ids come first. Repeated rows and ids are written
    each, equal ids in order of text. An empty table gives no files. Documents are dealt out by ranges of ids, each
    of which one task sorts, encodes and writes; ``start`` is the number of ids in all files before.
    """
    columns = "part long, path string, n_docs long, n_ids long"
    vocabulary = tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(tokenizer_path), TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        made, writer, path = [], None, f"{root}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            at = 0
            doc_ids = batch.column(0).to_pylist()
            for texts in by_bytes(batch.column(1).to_pylist(), BATCH_CHARS):
                for ids in encoder(texts, end_id):
                    writer = writer or TokenFileWriter(files.open_output_stream(path, compression=None, buffer_size=1 << 20), vocabulary)
                    writer.add(doc_ids[at], ids)
                    at += 1
        if writer:
            writer.close()
            writer.out.close()
            made = [(part, path, len(writer.lengths), sum(writer.lengths))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made) if made else [()] * 4, arrow_schema(columns), strict=True)], schema=arrow_schema(columns))

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = slim.repartitionByRange(1 + size // FILE_BYTES, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = cut(ordered.mapInArrow(run, columns.replace("long", "bigint")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32``, and with ``ids`` the token ids.

    One task per file, which decodes block after block. A file that is damaged or does not match the manifest
    fails the job.
    """
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    schema = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, n_docs, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, seen = [], 0
                with files.open_input_file(path) as data:
                    for seen, (doc_id, before, tokens) in enumerate(read_token_file(data, path), 1):
                        check = zlib.crc32(np.ascontiguousarray(tokens, dtype="<u4").tobytes())
                        rows.append((doc_id, start + before, len(tokens), check, *([tokens.astype(np.int64)] if ids else [])))
                        if len(rows) == (256 if ids else 8192):
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                            rows = []
                if seen != n_docs:
                    raise ValueError(f"{path}: {seen} documents for {n_docs}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    files = manifest.select("path", "n_docs", "start")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, columns.replace("long", "bigint"))
