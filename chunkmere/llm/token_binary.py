"""Operator 7: token-id files in Simple-8b, word-aligned.

A file holds blocks and a footer with each block's offset.  A block codes up to ``BLOCK_IDS`` ids
in 64-bit words: the top four bits select how many values of which width the other sixty hold, and
selector 0 is an escape, after which a value too wide for sixty bits follows as a whole word.  The
documents' ids and lengths are coded alike.  Both coding and decoding are vectorised: one pass over
an array for each selector.

Files hold documents in ascending order of their id: documents are dealt to ranges of ids (bounds
from quantiles of the id column), sorted within each, and cut into files of about ``FILE_IDS``
tokens.  Files are rows of a Parquet table in the shared folder, committed by Spark.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, shared_path, text_or_empty
from .tokens import encoder, slices

MAGIC = b"CMS8\x01\0\0\0"
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 20
#: Ranges of document ids, at most; each is sorted by one task, on disk where it must be.
MOST_RANGES = 1 << 14
#: How many values of which width each selector packs; 0 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
FILES = "range_no int, file_no int, n_ids long, content binary"


_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value takes."""
    if not len(v) or int(v.max()) < 1 << 16:
        return _BITS[v]
    if int(v.max()) < 1 << 32:
        return np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    high = v >> np.uint64(32)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """``values`` (uint64) as Simple-8b words."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.empty(0, np.uint64)
    choice = np.zeros(n, np.int8)
    # The widest of each 2**k values in a row, by bits; that of any number of them is the larger of two such runs'.
    widest = [_bits(v)]
    while 2 << len(widest) <= min(n, COUNTS[1]) * 2:
        half = 1 << (len(widest) - 1)
        widest.append(np.maximum(widest[-1][:-half], widest[-1][half:]))
    for sel in range(14, 0, -1):  # narrower selectors, which hold more values, overwrite wider ones
        c = int(COUNTS[sel])
        if c <= n:
            k = c.bit_length() - 1
            run = widest[k]
            many = n - c + 1
            fits = np.maximum(run[:many], run[c - (1 << k) : c - (1 << k) + many]) <= WIDTHS[sel]
            choice[:many][fits] = sel
    step = np.where(choice == 0, 1, COUNTS[choice]).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    sel = choice[starts]
    place = np.arange(len(starts)) + np.cumsum(sel == 0) - (sel == 0)
    words = np.zeros(len(starts) + int((sel == 0).sum()), np.uint64)
    words[place[sel == 0] + 1] = v[starts[sel == 0]]
    for k in range(1, 15):
        own = sel == k
        if own.any():
            c, b = int(COUNTS[k]), int(WIDTHS[k])
            begin = starts[own]
            held = v[begin] | np.uint64(k) << np.uint64(60)
            for i in range(1, c):
                held |= v[begin + i] << np.uint64(b * i)
            words[place[own]] = held
    return words


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of Simple-8b words."""
    sel = (words >> np.uint64(60)).astype(np.int8)
    counts = COUNTS[sel]
    raw, last = [], -1
    for i in np.flatnonzero(sel == 0).tolist():
        if i != last:  # else it is a whole value
            last = i + 1
            raw.append(last)
    raw = np.array(raw, np.int64)
    if len(raw) and raw[-1] >= len(words):
        raise ValueError("an escape without a value")
    sel[raw], counts[raw] = -1, 1
    if (sel == 15).any() or len(raw) != (sel == 0).sum():
        raise ValueError("unknown selector")
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begins = ends - counts
    out[begins[raw]] = words[raw]
    for k in range(1, 15):
        own = sel == k
        if own.any():
            c, b = int(COUNTS[k]), int(WIDTHS[k])
            shifts = np.arange(c, dtype=np.uint64) * np.uint64(b)
            out[begins[own][:, None] + np.arange(c)] = words[own][:, None] >> shifts & np.uint64((1 << b) - 1)
    return out


def _zigzag(v: np.ndarray) -> np.ndarray:
    return (v << 1 ^ v >> 63).view(np.uint64)


def _unzigzag(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)


def make_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file of documents in this order; ``ids`` has theirs one after another."""
    missing = np.array([d is None for d in doc_ids], np.uint64)
    numbers = np.array([d or 0 for d in doc_ids], np.int64)
    with np.errstate(over="ignore"):
        deltas = _zigzag(np.diff(numbers, prepend=np.int64(0)))
    out, offsets, at = [MAGIC], [], len(MAGIC)
    blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
    for values in [missing, deltas, np.asarray(lengths, np.uint64), *blocks]:
        held = pack(values).astype("<u8").tobytes()
        offsets.append(at)
        out.append(held)
        at += len(held)
    foot = struct.pack(f"<{len(offsets)}Q", *offsets) + struct.pack("<QQQI", at, len(doc_ids), len(ids), len(offsets))
    return b"".join(out) + foot + struct.pack("<I", zlib.crc32(foot)) + MAGIC


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a file, validated."""
    if len(content) < 48 or content[:8] != MAGIC or content[-8:] != MAGIC:
        raise ValueError("not a token file")
    end, docs, total, n = struct.unpack_from("<QQQI", content, len(content) - 40)
    foot = content[len(content) - 40 - 8 * n : -12]
    if zlib.crc32(foot) != struct.unpack_from("<I", content, len(content) - 12)[0]:
        raise ValueError("the footer is damaged")
    offsets = [*struct.unpack_from(f"<{n}Q", foot), end]
    part = [unpack(np.frombuffer(content[a:b], "<u8")) for a, b in zip(offsets, offsets[1:])]
    with np.errstate(over="ignore"):
        numbers = np.cumsum(_unzigzag(part[1])).tolist()
    lengths = part[2].astype(np.int64)
    ids = np.concatenate([np.empty(0, np.uint64), *part[3:]]).astype(np.uint32)
    if len(numbers) != docs or len(part[0]) != docs or len(lengths) != docs or len(ids) != total or lengths.sum() != total:
        raise ValueError("the file's counts differ from its footer")
    return [None if m else d for m, d in zip(part[0].tolist(), numbers)], lengths, ids


def _writer(path: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(path)
        now, number, docs, lengths, held, n = None, 0, [], [], [], 0

        def close() -> pa.RecordBatch:
            content = make_file(docs, np.array(lengths, np.int64), np.concatenate(held))
            return pa.RecordBatch.from_pydict({"range_no": pa.array([now], pa.int32()), "file_no": pa.array([number], pa.int32()), "n_ids": pa.array([n], pa.int64()), "content": pa.array([content], pa.binary())})

        for b in batches:
            ranges, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            row = 0
            for texts in slices(b.column(2), 8 << 20):
                ids, bounds = made.encode(texts)
                ids = np.insert(ids, bounds[1:], np.uint32(end_id))
                bounds = (bounds + np.arange(len(bounds))).tolist()
                for i in range(len(texts)):
                    if docs and (ranges[row] != now or n >= file_ids):
                        yield close()
                        number, docs, lengths, held, n = (number + 1 if ranges[row] == now else 0), [], [], [], 0
                    now = ranges[row]
                    own = ids[bounds[i] : bounds[i + 1]]
                    docs.append(names[row])
                    lengths.append(len(own))
                    held.append(own)
                    n += len(own)
                    row += 1
        if docs:
            yield close()

    return run


def _range_of(id_col: Column, bounds: list[int]) -> Column:
    """How many bounds lie below an id: in the JVM while they are few, else by a binary search."""
    if len(bounds) <= 128:
        return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda x: x < id_col))
    held = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def run(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, ids.fillna(0).to_numpy(np.int64), "left").astype(np.int32))

    return run(id_col)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, file_ids: int = FILE_IDS) -> None:
    """Encode whole texts (null: empty), each with ``end_id`` after it, to the table of files at ``path``.

    Documents are in ascending order of id, null ids first; rows that share an id are in the order of
    their texts.  An empty table gives a table without files.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    ranges = ranges or min(MOST_RANGES, max(1, docs.rdd.getNumPartitions()))
    bounds = sorted(set(rows.stat.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    number = _range_of(F.col("id"), [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in bounds])
    dealt = rows.select(F.when(F.col("id").isNull(), 0).otherwise(number).cast("int").alias("range_no"), "id", "text")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("range_no")).sortWithinPartitions("range_no", F.col("id").asc_nulls_first(), "text")
    dealt.mapInArrow(_writer(tokenizer, end_id, file_ids), FILES).write.option("compression", "uncompressed").parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r, f, content in zip(*(b.column(i) for i in range(3))):
            docs, lengths, ids = read_file(content.as_buffer().to_pybytes())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_pydict(
                {"range_no": pa.array([r.as_py()] * len(docs), pa.int32()), "file_no": pa.array([f.as_py()] * len(docs), pa.int32()), "id": pa.array(docs, pa.int64()), "at": pa.array(ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            )


def read_token_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """From the files at ``path``, per document: ``id_col, start, n_tokens, ids_crc32``."""
    files = spark.read.schema(FILES).parquet(path)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    # Where each range begins is summed over the ranges (a fixed number), and each file's place over its range's files.
    ranges = files.groupBy("range_no").agg(F.sum("n_ids").alias("n")).select("range_no", F.coalesce(F.sum("n").over(before().orderBy("range_no")), F.lit(0)).alias("range_start"))
    places = files.select("range_no", "file_no", F.coalesce(F.sum("n_ids").over(before("range_no").orderBy("file_no")), F.lit(0)).alias("file_start")).join(ranges, "range_no")
    docs = files.select("range_no", "file_no", "content").mapInArrow(_reader, "range_no int, file_no int, id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(places, ["range_no", "file_no"]).select(F.col("id").alias(id_col), (F.col("range_start") + F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of the files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                docs, lengths, ids = read_file(content.as_buffer().to_pybytes())
                bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "ids": pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32)))})

    return spark.read.schema(FILES).parquet(path).select("content").mapInArrow(run, "doc_id long, ids array<int>")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the documents' token files to the shared folder and read the index back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, id_col, text_col, file_ids=file_ids)
    return read_token_index(docs.sparkSession, path, id_col)
