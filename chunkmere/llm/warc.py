"""Operator 2: Zstandard WARC archives: a writer, and a reader that decodes one frame a record.

An archive (``.warc.zst``) is a leading skippable frame that holds the dictionary, then one
Zstandard frame for each WARC/1.1 record.  The reader loads the dictionary, finds each frame's end
from its block headers, decodes the frame alone and validates version line, field syntax,
Content-Length, the closing CRLFs, block and payload digests.

Archives are written as rows ``(archive, records, content)`` of a Parquet table in the shared
folder, which Spark commits once a task has succeeded, so a lost executor leaves no half archive;
:func:`export_archives` puts them out as plain files and :func:`read_files` reads such files with
Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach_groups, bound_batches, cut, shared_path, text_or_empty

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
#: Raw bytes after which an archive is closed, and of its dictionary; the dictionary is fitted on at most so many of its records.
ARCHIVE_BYTES, DICT_BYTES, DICT_RECORDS = 8 << 20, 16 << 10, 64
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVES = "archive string, records long, content binary"
RECORDS = "record_id string, target_uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- records


def make_record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str = DATE) -> bytes:
    """A response record with its HTTP message, or, if it refers to another, a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~") if uri is not None else "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields and payload, validated."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"no WARC version line: {data[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        k, colon, v = line.decode("utf-8").partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", k):
            raise WarcError(f"bad field {line!r}")
        fields[k.lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise WarcError(f"no {k}")
    if not re.fullmatch(r"\d+", fields["content-length"]):
        raise WarcError(f"bad Content-Length {fields['content-length']}")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, the block and its end have {len(rest)} bytes")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest differs")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP head")
    m = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    if not m:
        raise WarcError("no HTTP Content-Length")
    full = int(m[1])
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind == "response":
        if len(payload) != full:
            raise WarcError(f"HTTP Content-Length is {full}, the payload has {len(payload)} bytes")
        if digest != f"sha1:{sha1_base32(payload)}":
            raise WarcError("payload digest differs")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise WarcError("a revisit with a payload or without WARC-Refers-To")
    else:
        raise WarcError(f"unknown record type {kind}")
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    return {
        "record_id": bare("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "record_type": kind, "refers_to": bare("warc-refers-to"),
        "payload_bytes": full, "payload_digest": digest.removeprefix("sha1:"), "payload": payload if kind == "response" else None,
    }


# ---------------------------------------------------------------- archives


def make_archive(records: list[bytes]) -> bytes:
    """The dictionary's frame, then a frame for each record.  Where no dictionary can be fitted, its frame is empty."""
    step = max(1, len(records) // DICT_RECORDS)
    samples = [r[: 64 << 10] for r in records[::step][:DICT_RECORDS]]
    raw = b""
    if sum(map(len, samples)) >= 8 * DICT_BYTES and len(samples) >= 8:
        try:
            raw = zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            raw = b""
    made = zstandard.ZstdCompressionDict(raw) if raw else None
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True, write_content_size=True)
    kept = zstandard.ZstdCompressor(level=LEVEL).compress(raw) if raw else b""
    return struct.pack("<II", SKIPPABLE, len(kept)) + kept + b"".join(map(coder.compress, records))


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, by its block headers."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise WarcError(f"no Zstandard frame at {at}")
    info = data[at + 4]
    end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        if end + 3 > len(data):
            raise WarcError("archive ends inside a frame")
        head = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a run-length block is one byte
        if head & 1:
            break
    end += 4 * (info >> 2 & 1)
    if end > len(data):
        raise WarcError("archive ends inside a frame")
    return end


def read_archive(content: bytes) -> Iterator[dict]:
    """The archive's records in order, each decoded from its own frame."""
    data = memoryview(content)
    if len(data) < 8:
        raise WarcError("no leading skippable frame")
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or 8 + n > len(data):
        raise WarcError("no leading skippable frame with a dictionary")
    raw = bytes(data[8 : 8 + n])
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + n
    while at < len(data):
        end = frame_end(data, at)
        try:
            record = coder.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at {at}: {e}") from e
        yield parse_record(record)
        at = end


def _write_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records: list[bytes] = []
    held, number, part = 0, 0, TaskContext.get().partitionId()

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": [f"part-{part:06d}-{number:05d}.warc.zst"], "records": pa.array([len(records)], pa.int64()), "content": pa.array([make_archive(records)], pa.binary())})

    for b in batches:
        ids, uris, refers, payloads = (b.column(i) for i in range(4))
        for i in range(b.num_rows):
            records.append(make_record(ids[i].as_py(), uris[i].as_py(), payloads[i].as_buffer().to_pybytes(), refers[i].as_py()))
            held += len(records[-1])
            if held >= ARCHIVE_BYTES:
                yield close()
                records, held, number = [], 0, number + 1
    if records:
        yield close()


def write_archives(records: DataFrame, path: str) -> None:
    """Write rows ``(record_id, target_uri, refers_to, payload binary)`` as archives to the table at ``path``."""
    out = records.select("record_id", "target_uri", "refers_to", "payload").mapInArrow(_write_partition, ARCHIVES)
    out.write.option("compression", "uncompressed").parquet(path)


def _read_content(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")][: None if payload else -1]
        types = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        for b in batches:
            for content in b.column(0):
                rows = list(read_archive(content.as_buffer().to_pybytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)

    return run


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in the table at ``path``; without ``payload`` it is validated and left out."""
    schema = RECORDS if payload else RECORDS.rpartition(", ")[0]
    return spark.read.schema(ARCHIVES).parquet(path).select("content").mapInArrow(_read_content(payload), schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of plain ``.warc.zst`` files at ``path`` (a folder or glob)."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read_content(True), RECORDS)


def export_archives(spark: SparkSession, path: str, folder: str) -> None:
    """Put the archives of the table at ``path`` out as files in ``folder``, a mount that all executors share."""

    def put(row) -> None:
        to = os.path.join(folder, row.archive)
        held = f"{to}.{os.getpid()}.part"
        with open(held, "wb") as f:
            f.write(row.content)
        os.replace(held, to)

    os.makedirs(folder, exist_ok=True)
    spark.read.schema(ARCHIVES).parquet(path).foreach(put)


def crawl_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Records to write, one for each page.

    The payload is the html in UTF-8 (null: empty).  Of pages with equal payloads of at least
    ``least_bytes`` bytes that with the largest id is the response and the others revisit it;
    smaller payloads are all responses.  A page with a null id takes the name ``urn:x-page:null`` and
    loses to any other; where all ids of a payload are null, all are responses.  Repeated rows of the
    response are responses too.  Rows of one id with different payloads are pages of their own.  A
    null url becomes ``about:blank``.  An empty table gives no archive and no record.
    """
    html = text_or_empty(html_col)
    page = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), F.encode(html, "UTF-8").alias("payload"), F.unhex(F.sha2(html, 256)).alias("sha"))
    keys = cut(pages.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(html, 256)).alias("sha"), F.octet_length(html).alias("n")).filter(F.col("n") >= least_bytes))
    groups = keys.groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n_equal")).filter("n_equal > 1")
    groups = cut(groups)
    # Only pages whose payload occurs again need to learn of their group.
    again = attach_groups(keys.select("id", "sha"), groups, "sha", "n_equal").filter("first is not null and not id <=> first").select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), "first").distinct()
    again = cut(again)
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    name = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")))
    joined = page.join(again, F.col("id").eqNullSafe(F.col("__id")) & F.col("sha").eqNullSafe(F.col("__sha")), "left")
    return joined.select(name(F.col("id")).alias("record_id"), "target_uri", F.when(F.col("first").isNotNull(), name(F.col("first"))).alias("refers_to"), "payload")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page, read the archives back: ``record_id, target_uri, record_type, refers_to, payload_bytes, payload_digest``."""
    spark = pages.sparkSession
    bound_batches(spark)
    path = shared_path(spark, "warc")
    write_archives(crawl_records(pages, id_col, url_col, html_col, least_bytes), path)
    return read_archives(spark, path, payload=False)
