"""WARC archives of individually compressed records with a shared Zstandard dictionary.

An archive (``.warc.zst``) begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
built from the archive's own records; each record is a Zstandard frame of its own, so one can be read
alone. Spark's text writer makes the files: every frame is one value written as raw bytes, and the line
separator is an empty skippable frame, which decoders pass over. Files thus go to any file system that
Spark writes to, under its commit protocol, and a lost task leaves no half archive.

Records with an equal payload of at least ``MIN_REVISIT_BYTES`` are stored once: the one with the least
page id is a response, the others are revisits that refer to it and keep its HTTP header.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrid.llm.common import cut, map_batches

#: Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 100
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on so many bytes of an archive's first records at most.
TRAINING_BYTES = 8 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "about:blank")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}", "WARC-Truncated: length"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the records' own bytes."""
    total = sum(map(len, records))
    size = min(size, max(1024, total // 8))
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(size, records, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-size:]


def encode_archive(records: Iterable[bytes], training_bytes: int = TRAINING_BYTES) -> Iterator[bytes]:
    """The frames of one archive: the dictionary's, then one for each record."""
    records, first, size = iter(records), [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= training_bytes:
            break
    if not first:
        return
    data = build_dictionary(first)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data))
    for r in chain(first, records):
        yield compressor.compress(r)


def decode_archive(blob: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; the archive is decompressed as a stream."""
    if not blob:
        return
    magic, size = struct.unpack_from("<II", blob)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("not a dictionary-compressed archive")
    dictionary = zstandard.ZstdCompressionDict(bytes(blob[8 : 8 + size]))
    source = io.BytesIO(blob)
    source.seek(8 + size)
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name.lower()] = value
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


def _frames(training_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        frames, size = [], 0
        for frame in encode_archive((encode_record(i, url, data or b"", digest, ref) for i, url, data, digest, ref in rows), training_bytes):
            frames.append(frame)
            size += len(frame)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])
                frames, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])

    return run


def with_references(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each page; ``refers_to`` is null for a response."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copies = (
        rows.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("digest", "first")
    )
    # Written before it is joined: both sides then have an exchange of their own, and AQE may split a
    # digest that very many pages share.
    copies = cut(copies)
    refers = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    return rows.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, training_bytes: int = TRAINING_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to archives in the folder ``path``.

    A null html is an empty payload, a null url ``about:blank``. Of rows that repeat the least page id of
    a payload each is a response; rows with a null id refer to a payload's least id if there is one.
    A payload of any length is one record. One archive is written for each task; an empty table gives no
    record. Further columns are not read.
    """
    frames = map_batches(with_references(pages, min_bytes), _frames(training_bytes), "value binary")
    frames.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", EMPTY_FRAME).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of all records in ``path``.

    A response's size and digest are those of its payload, and a payload that differs from the digest in
    its header raises; a revisit has no payload, its size and digest are those its headers state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            for blob in batch.column(0):
                rows, size = [], 0
                for headers, block in decode_archive(blob.as_buffer()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if headers["warc-type"] == "response" and (len(payload) != stated or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                    page, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    rows.append((page and int(page), headers["warc-target-uri"], headers["warc-type"], first and int(first), stated, digest, payload if headers["warc-type"] == "response" else None))
                    size += len(payload)
                    if size >= 8 << 20:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return map_batches(files, run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
