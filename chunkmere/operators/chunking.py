"""Chunking and the maps between files and chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import in_order

# ---------------------------------------------------------------- fixed size


def fixed_chunks(files: DataFrame, size: int, keep: bool = False) -> DataFrame:
    """``path, seq, offset, size, hash`` of pieces of ``size`` bytes; with ``keep`` also their ``content``."""
    raw = F.col("content").cast("binary")
    starts = F.when(F.octet_length("content") > 0, F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(size)))
    parts = files.select("path", raw.alias("raw"), F.posexplode(starts).alias("seq", "at")).select("path", "seq", F.col("at").cast("long").alias("offset"), F.expr(f"substring(raw, at + 1, {size})").alias("content"))
    out = parts.select("path", "seq", "offset", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"), "content")
    return out if keep else out.drop("content")


# ---------------------------------------------------------------- content-defined


@lru_cache(maxsize=4)
def rolling_table(seed: bytes) -> np.ndarray:
    """256 values of 64 bits: a chain of SHA-256 from the seed, four values each, little-endian (T4)."""
    out, h = [], seed
    for _ in range(64):
        h = hashlib.sha256(h).digest()
        out.append(np.frombuffer(h, "<u8"))
    return np.concatenate(out)


#: Bytes whose hashes are worked out at once.
SEGMENT = 1 << 20


def _hits(data: np.ndarray, average: int, smallest: int, seed: bytes) -> np.ndarray:
    """The places after which a chunk may end: where the last ``smallest`` bytes' hash has its low bits zero.

    The cyclic-polynomial hash for all positions of a segment at once: each byte's value is rotated by
    its position, runs of them are xored by prefix, and a window's hash is the difference of two
    prefixes rotated back.
    """
    found = []
    for low in range(0, len(data) - smallest + 1, SEGMENT):
        part = data[low : min(len(data), low + SEGMENT + smallest - 1)]
        at = np.arange(len(part), dtype=np.uint64) & np.uint64(63)
        v = rolling_table(seed)[part]
        back = np.uint64(64) - at & np.uint64(63)
        prefix = np.bitwise_xor.accumulate(v >> at | v << back)
        window = prefix[smallest - 1 :].copy()
        window[1:] ^= prefix[:-smallest]
        turn = at[smallest - 1 :]
        back = np.uint64(64) - turn & np.uint64(63)
        found.append(np.flatnonzero(((window << turn | window >> back) & np.uint64(average - 1)) == 0) + smallest + low)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cut_points(data: bytes, average: int, largest: int, smallest: int, seed: bytes = b"chunkmere") -> list[int]:
    """Where the chunks of a byte stream end.

    A chunk ends at the first place, ``smallest`` bytes or more from its start, where the hash of the
    last ``smallest`` bytes has its low bits zero, or at ``largest``.
    """
    n = len(data)
    if smallest == largest:
        return list(range(smallest, n, smallest)) + ([n] if n else [])
    if n <= smallest:
        return [n] if n else []
    hits = _hits(np.frombuffer(data, np.uint8), average, smallest, seed)
    out, start = [], 0
    while n - start > smallest:
        k = int(np.searchsorted(hits, start + smallest))
        end = int(hits[k]) if k < len(hits) else n
        end = min(end, start + largest, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


class ChunkStream:
    """Chunks of files that are fed window by window; with ``pack`` a chunk goes on from one file into the next.

    ``feed`` and ``close`` give ``(content, [(file, its number of the piece, start, stop, place in the file)])`` for
    each chunk that is whole: no more than a chunk and a window are held.
    """

    def __init__(self, average: int, largest: int, smallest: int, seed: bytes = b"chunkmere", pack: bool = False):
        self.settings, self.largest, self.pack = (average, largest, smallest, seed), largest, pack
        self.buffer, self.base = bytearray(), 0  # base: the stream's place of the buffer's first byte
        self.open: list[list] = []  # [file, begin, end, pieces so far] in the stream

    def feed(self, file: object, data: bytes, last: bool) -> Iterator[tuple[bytes, list[tuple]]]:
        """More of a file; files come one after another, each with ``last`` at its end."""
        begin = self.base + len(self.buffer)
        if not self.open or self.open[-1][0] != file:
            self.open.append([file, begin, begin, 0])
        self.buffer += data
        self.open[-1][2] = begin + len(data)
        if last and not self.pack:
            yield from self.close()
        elif len(self.buffer) > 2 * self.largest:
            yield from self._drain(False)

    def close(self) -> Iterator[tuple[bytes, list[tuple]]]:
        yield from self._drain(True)
        self.open = []

    def _drain(self, final: bool) -> Iterator[tuple[bytes, list[tuple]]]:
        data, start = bytes(self.buffer), 0
        ends = cut_points(data, *self.settings)
        for end in ends if final else ends[:-1]:  # the last one may go on
            low, high, pieces = self.base + start, self.base + end, []
            for f in self.open:
                if f[1] < high and f[2] > low:
                    pieces.append((f[0], f[3], max(low, f[1]) - low, min(high, f[2]) - low, max(low, f[1]) - f[1]))
                    f[3] += 1
            yield data[start:end], pieces
            start = end
        self.base += start
        del self.buffer[:start]
        self.open = [f for f in self.open if f[2] > self.base or f is self.open[-1]]


def content_chunks(files: DataFrame, average: int, largest: int, smallest: int, seed: bytes = b"chunkmere", hash_key: bytes = b"chunkmere", keep: bool = False) -> DataFrame:
    """``path, seq, offset, size, hash`` of content-defined chunks of each file, by itself.

    Files are chunked in parallel, so a chunk doesn't go from one file into the next.
    """
    schema = "path string, seq int, offset long, size long, hash string" + (", content binary" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                if not content.is_valid:
                    continue
                data, start = content.as_buffer().to_pybytes(), 0
                for k, end in enumerate(cut_points(data, average, largest, smallest, seed)):
                    part = data[start:end]
                    rows.append((path, k, start, end - start, hashlib.blake2b(part, digest_size=32, key=hash_key).hexdigest(), part))
                    start = end
            cols = list(zip(*rows)) if rows else [()] * 6
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["path", "seq", "offset", "size", "hash", "content"]
            k = 6 if keep else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], types[:k])], names[:k])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def metadata_chunks(lines: DataFrame, average: int = 1 << 20, run: int = 4096, seed: bytes = b"chunkmere", hash_key: bytes = b"chunkmere", keep: bool = False) -> DataFrame:
    """``id, run, seq, offset, size, hash`` of content-defined chunks of each id's ``(id string, path, line)`` in path order.

    Every line ends with a newline; chunks are from a quarter of ``average`` to four times that.  A list is
    cut before paths whose hash ``run`` divides, and each run is a stream of its own: a long list is many
    tasks', whatever its id, and an entry that comes or goes changes the chunks of its run alone.
    Offsets count from the run's start.
    """
    first = (F.expr(f"pmod(xxhash64(path), {run})") == 0).cast("long")
    laid = in_order(lines.select("id", "path", "line", first.alias("first")), ["path"], F.col("first"), ["id"])
    of_run = laid.groupBy("id", (F.col("before") + F.col("first")).alias("run")).agg(F.array_sort(F.collect_list(F.struct("path", "line"))).alias("held"))
    text = F.array_join(F.transform("held", lambda x: F.concat(x["line"], F.lit("\n"))), "")
    found = content_chunks(of_run.select(F.concat_ws(":", "run", "id").alias("path"), text.alias("content")), average, 4 * average, average // 4, seed, hash_key, keep)
    return found.select(F.expr("substring(path, instr(path, ':') + 1)").alias("id"), F.substring_index("path", ":", 1).cast("long").alias("run"), *found.columns[1:])


# ---------------------------------------------------------------- maps


def running_offsets(rows: DataFrame, group: list[str], order: list[str], size: str = "size") -> DataFrame:
    """Adds ``begin`` and ``end``: the bytes before a row in its group, and with it."""
    return in_order(rows, order, F.col(size), group).withColumnRenamed("before", "begin").withColumn("end", F.col("begin") + F.col(size))


def file_chunk_map(files: DataFrame, chunks: DataFrame, group: list[str], bucket: int) -> DataFrame:
    """Place files ``(group, path, begin, end)`` on chunks ``(group, seq, begin, end)`` of the same stream.

    An interval join as an equi-join: both sides are dealt to the buckets of ``bucket`` bytes that they
    touch, and a pair is taken in the bucket where its overlap begins.  A file that ends where a chunk
    does doesn't touch the next.  Columns: group, path, seq, start, stop (within the chunk).
    """
    deal = lambda df: df.filter("end > begin").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin") / bucket), F.floor((F.col("end") - 1) / bucket))))
    f = deal(files).select(*group, "bucket", "path", F.col("begin").alias("f_begin"), F.col("end").alias("f_end"))
    c = deal(chunks).select(*group, "bucket", "seq", F.col("begin").alias("c_begin"), F.col("end").alias("c_end"))
    begin = F.greatest("f_begin", "c_begin")
    met = f.join(c, [*group, "bucket"]).filter((F.col("f_begin") < F.col("c_end")) & (F.col("f_end") > F.col("c_begin")) & (F.floor(begin / bucket) == F.col("bucket")))
    return met.select(*group, "path", "seq", (begin - F.col("c_begin")).alias("start"), (F.least("f_end", "c_end") - F.col("c_begin")).alias("stop"))


def file_ranges(placed: DataFrame, group: list[str]) -> DataFrame:
    """Per file: first chunk and offset in it, last chunk and offset (the content of an entry)."""
    return placed.groupBy(*group, "path").agg(
        F.min(F.struct("seq", "start")).alias("a"), F.max(F.struct("seq", "stop")).alias("b"), F.sum(F.col("stop") - F.col("start")).alias("size")
    ).select(*group, "path", F.col("a.seq").alias("start_chunk"), F.col("a.start").alias("start_offset"), F.col("b.seq").alias("end_chunk"), F.col("b.stop").alias("end_offset"), "size")


def delta_encode(ranges: DataFrame, group: list[str], order: str) -> DataFrame:
    """Start chunks as the distance to the last end chunk, end chunks as that to the start."""
    placed = in_order(ranges, [order], F.lit(0), group, lag="end_chunk").drop("before")
    return placed.withColumn("d_start", F.col("start_chunk") - F.coalesce("previous", F.lit(0))).withColumn("d_end", F.col("end_chunk") - F.col("start_chunk")).drop("previous")


def delta_decode(deltas: DataFrame, group: list[str], order: str) -> DataFrame:
    """The chunks of ``d_start`` and ``d_end`` again, by a running sum."""
    placed = in_order(deltas, [order], F.col("d_start") + F.col("d_end"), group)
    out = placed.withColumn("start_chunk", F.col("before") + F.col("d_start")).drop("before")
    return out.withColumn("end_chunk", F.col("start_chunk") + F.col("d_end"))


def dense_numbers(rows: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """Adds ``number``: counts up where ``key``, a column of long values, differs from the row before."""
    placed = in_order(rows, order, F.lit(1), group, lag=key)
    fresh = (F.col("before") > 0) & ~F.col(key).eqNullSafe(F.col("previous"))
    placed = in_order(placed.withColumn("fresh", fresh.cast("long")).drop("previous").withColumnRenamed("before", "place"), ["place"], F.col("fresh"), group)
    return placed.withColumn("number", F.col("before") + F.col("fresh")).drop("fresh", "before", "place")


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, size, held = None, 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "size": pa.array([size], pa.int64()), "hash": pa.array([held.hexdigest()], pa.string())})

    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1)):
            if held is None or name != path:
                if held is not None:
                    yield out()
                path, size, held = name, 0, hashlib.sha256()
            if content.is_valid:
                part = content.as_buffer()
                held.update(part)
                size += part.size
    if held is not None:
        yield out()


def read_back(chunks: DataFrame) -> DataFrame:
    """Files from their chunks ``(path, seq, content)``: ``path, size, hash`` of the bytes in order.

    A file's hash runs over its bytes one after another, so a file is one task's; it is streamed, a
    batch of chunks at a time, and never held whole.
    """
    laid = chunks.select("path", "seq", "content").repartition("path").sortWithinPartitions("path", "seq")
    return laid.select("path", "content").mapInArrow(_hash_files, "path string, size long, hash string")


def ordered_checksum(rows: DataFrame, group: list[str], order: str, value: str, bucket: int = 4096) -> DataFrame:
    """A tree of SHA-256 over a group's values in order (A16): of the values of each ``bucket`` of the order, then of these digests."""

    def level(parts: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct(by, "v")))
        return parts.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(held, lambda x: x["v"]), ""), 256).alias(name))

    parts = rows.select(*group, F.expr(f"`{order}` div {bucket}").alias("bucket"), order, F.col(value).cast("string").alias("v"))
    return level(level(parts, [*group, "bucket"], order, "v"), group, "bucket", "checksum")


def context_lines(lines: DataFrame, group: list[str], order: str, changed: str, before: int = 10, after: int = 10) -> DataFrame:
    """Lines within ``before`` lines above or ``after`` below a changed one."""
    near = F.max(F.col(changed).cast("int")).over(Window.partitionBy(*group).orderBy(order).rowsBetween(-after, before))
    return lines.withColumn("near", near).filter("near = 1").drop("near")
