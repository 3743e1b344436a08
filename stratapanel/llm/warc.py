"""Web archives of one Zstandard frame per record, with the dictionary in a leading skippable frame.

Writing and reading run in the tasks of a Spark job; files go to a folder that all executors share, and a
written manifest says which of them count, so that a repeated task cannot add records twice.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapanel.llm.common import arrow_schema, cut

#: Fixed values of the formats: skippable frame that holds a dictionary, start of a frame, start of a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of the records from which an archive's dictionary is learnt, of the dictionary, and of an archive.
SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 2 << 20, 64 << 10, 64 << 20
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The record of a page: a response with the payload, or a revisit without."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to), "Refers-To-Page-ID": str(refers_to)}
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    fields |= {"Payload-Length": str(len(payload)), "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http;msgtype=response"}
    return _record(fields, block)


class ArchiveWriter:
    """Archives of one task in a folder; a new one is begun when one is full."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.made: list[tuple[str, int, int]] = []

    def write(self, records: Iterator[bytes]) -> None:
        for first in records:
            self._archive(chain([first], records))

    def _archive(self, records: Iterator[bytes]) -> None:
        samples, held = [], 0
        for record in records:
            samples.append(record)
            held += len(record)
            if held >= SAMPLE_BYTES:
                break
        dictionary = learn_dictionary(samples)
        path = f"{self.root}/part-{TaskContext.get().partitionId() if TaskContext.get() else 0:05d}-{uuid.uuid4().hex}.warc.zst"
        compress = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True).compress
        n = 0
        with self.fs.open_output_stream(path, compression=None, buffer_size=1 << 20) as out:
            if dictionary:
                content = dictionary.as_bytes()
                out.write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
            info = b"software: panel archives\r\nformat: WARC file version 1.1\r\n"
            out.write(compress(_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, info)))
            for record in chain(samples, records):
                out.write(compress(record))
                n += 1
                if n >= len(samples) and out.tell() >= ARCHIVE_BYTES:
                    break
            size = out.tell()
        self.made.append((path, n, size))


def learn_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the first records of an archive; none where they are too few to learn from."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    if len(samples) < 16 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:  # records too short or too much alike
        return None


def _frames(source: pa.NativeFile, path: str) -> Iterator[bytes]:
    """The content of each frame in turn; the dictionary comes from a skippable frame at the start."""
    data, at, dictionary = source.read(1 << 16), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        if len(data) < 8 + size:
            data += source.read(8 + size - len(data))
        content, at = data[8 : 8 + size], 8 + size
        if len(content) != size:
            raise ValueError(f"{path}: the dictionary is cut off")
        if content[:4] == FRAME:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        if content[:4] != DICTIONARY:
            raise ValueError(f"{path}: the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(content)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    data = data[at:]
    while data or (data := source.read(1 << 16)):
        frame, parts = reader.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"{path}: damaged frame: {e}") from e
            if frame.eof:
                data = frame.unused_data
                break
            if not (data := source.read(1 << 16)):
                raise ValueError(f"{path}: the last frame is cut off")
        yield b"".join(parts)


def parse_record(data: bytes, path: str) -> tuple[dict[str, str], bytes]:
    """Fields (by lower-case name) and block of one record, after checking headers, lengths and digests."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(end, 0)].decode().split("\r\n")
    if end < 0 or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"{path}: a frame does not start with a record header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip() or name.strip().lower() in fields:
            raise ValueError(f"{path}: bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"{path}: a record lacks {sorted(missing)}")
    length = fields["content-length"]
    if not length.isascii() or not length.isdigit() or len(data) != end + 4 + int(length) + 4 or data[-4:] != b"\r\n\r\n":
        raise ValueError(f"{path}: a record is not as long as its header says")
    block = data[end + 4 : -4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"{path}: a block differs from its digest")
    return fields, block


_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archive(path: str, folder: str) -> Iterator[tuple]:
    """The page records of an archive as rows of ``_RECORD``; any fault raises an error that names the file."""
    files, _ = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(path, compression=None) as source:
        for data in _frames(source, path):
            fields, block = parse_record(data, path)
            kind = fields["warc-type"]
            if kind == "warcinfo":
                continue
            head, blank, body = block.partition(b"\r\n\r\n")
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            size = int(fields["payload-length"])
            if kind not in ("response", "revisit") or not blank or f"Content-Length: {size}".encode() not in head.split(b"\r\n"):
                raise ValueError(f"{path}: a {kind} record has no valid response header")
            if kind == "response" and (len(body) != size or base32_sha1(body) != digest):
                raise ValueError(f"{path}: a payload differs from its length or digest")
            if kind == "revisit" and (body or fields.get("warc-profile") != PROFILE):
                raise ValueError(f"{path}: a revisit is not one of an identical payload")
            number = [int(fields[name]) if name in fields else None for name in ("page-id", "refers-to-page-id")]
            yield number[0], fields.get("warc-target-uri"), kind, number[1], size, digest, body if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per page; returns the stored manifest (``path``, ``records``, ``bytes``).

    Null html is an empty payload, a null url has no target field, a null id no id field. Of equal payloads the
    smallest id is the response (all its rows, if repeated), the others, null ids too, revisit it; if all ids are
    null, all are responses. An empty table gives an empty manifest. Payloads meet by digest, and only ids and
    digests are aggregated; a payload that a third of all pages share is split by adaptive execution.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.filter(F.octet_length("payload") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(shared.filter("n > 1").select("digest", "first"), "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    columns = "path string, records long, bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder)
        writer.write(page_record(*row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*writer.made) if writer.made else [()] * 3, arrow_schema(columns), strict=True)], schema=arrow_schema(columns))

    return cut(rows.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, columns.replace("long", "bigint")))


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The page records of the archives in a manifest: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload``.

    One task per archive, which is read as a stream. A damaged archive, or one with other than the manifest's
    number of records, fails the job.
    """
    columns = _RECORD if payloads else _RECORD.removesuffix(", payload binary")
    schema = arrow_schema(columns)

    def rows(path: str, expected: int) -> Iterator[tuple]:
        n = 0
        for n, row in enumerate(read_archive(path, folder), 1):
            yield row
        if n != expected:
            raise ValueError(f"{path}: {n} records for {expected}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows(path, expected):
                    held.append(row[: len(schema)])
                    size += len(row[6] or b"") * payloads + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)

    files = manifest.select("path", "records")
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, columns.replace("long", "bigint"))
