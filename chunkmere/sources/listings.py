"""Listings of older and of other stores: entries as JSON objects in a list, and as a stream of MessagePack records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..model import MODE_DIR, MODE_LINK

RANGE = ["start_chunk", "start_offset", "end_chunk", "end_offset"]
# The names of an entry's fields in a JSON list.
JSON_ENTRY = "name string, path string, size long, time long, mode long, hash string, link string, uid int, gid int, attributes map<string,string>, content string"
# The fields of a record in their order, the attributes' number and pairs after them.
RECORD = ["path", "size", "time", "mode", "link", "hash", *RANGE, "uid", "gid"]
TEXTS = {"path", "link", "hash"}
LISTED = ", ".join(f"{n} {'string' if n in TEXTS else 'long'}" for n in RECORD) + ", attributes map<string,binary>"
#: Entries that a batch holds.
BATCH = 8192


def _is_file(mode: Column) -> Column:
    return mode.bitwiseAND(F.lit(MODE_DIR | MODE_LINK)) == 0


# ---------------------------------------------------------------- JSON lists


def entry_json() -> Column:
    """An entry as its JSON object (K20); absent values are left out, and the range of a file without bytes too."""
    has_range = _is_file(F.col("mode")) & (F.col("size") > 0)
    owned = (F.col("uid") != -1) & (F.col("gid") != -1)
    return F.to_json(F.struct(
        F.base64(F.col("path").cast("binary")).alias("name"), "size", "time", "mode", "hash", F.when(F.col("link") != "", F.col("link")).alias("link"),
        F.when(owned, F.col("uid")).alias("uid"), F.when(owned, F.col("gid")).alias("gid"), F.when(F.size("attributes") > 0, F.transform_values("attributes", lambda _, v: F.base64(v))).alias("attributes"),
        F.when(has_range, F.concat_ws(":", *RANGE)).alias("content"),
    ))


def listed(objects: DataFrame, *keep: str) -> DataFrame:
    """Entries (LISTED) from the columns of JSON_ENTRY, those of ``keep`` before them; an object that lacks a field ends the job."""
    path = F.when(F.col("name").isNotNull(), F.to_binary("name", F.lit("base64")).cast("string")).otherwise(F.col("path"))

    def needed(value: Column, what: str) -> Column:
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"no valid {what} for "), F.coalesce(path, F.lit("an entry")))))

    has_range = _is_file(F.col("mode")) & (F.col("size") > 0)
    numbers = F.when(F.col("content").rlike("^[0-9]+:[0-9]+:[0-9]+:[0-9]+$"), F.split("content", ":"))
    parts = [F.when(has_range, needed(numbers, "content")[i]).otherwise(F.lit("0")).cast("long").alias(n) for i, n in enumerate(RANGE)]
    owner = [F.coalesce(F.col(n).cast("long"), F.lit(-1)).alias(n) for n in ("uid", "gid")]
    attributes = F.transform_values("attributes", lambda _, v: F.to_binary(F.coalesce(v, F.lit("")), F.lit("base64")))
    return objects.select(*keep, needed(path, "path").alias("path"), *(needed(F.col(n), n).alias(n) for n in ("size", "time", "mode")), F.coalesce("link", F.lit("")).alias("link"), needed(F.col("hash"), "hash").alias("hash"), *parts, *owner, attributes.alias("attributes"))


def read_json_lists(spark: SparkSession, path: str) -> DataFrame:
    """Entries of files that hold a JSON list each, with ``file``; a list is parsed by one task, lists are spread over tasks.

    What isn't JSON ends the job.  The order is that of ``functions.paths.collation_key``, by sorting.
    """
    raw = spark.read.schema(JSON_ENTRY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return listed(raw.select("*", F.col("_metadata.file_path").alias("file")), "file")


# ---------------------------------------------------------------- records


def _int(n: int) -> bytes:
    """The shortest form of an integer."""
    if -32 <= n < 128:
        return n.to_bytes(1, "big", signed=n < 0)
    for k in range(4):
        if n < 0 and n >= -(1 << (8 * 2**k - 1)):
            return bytes([0xD0 + k]) + n.to_bytes(2**k, "big", signed=True)
        if 0 < n < 1 << 8 * 2**k:
            return bytes([0xCC + k]) + n.to_bytes(2**k, "big")
    raise OverflowError(n)


def _text(raw: bytes) -> bytes:
    n = len(raw)
    if n < 32:
        return bytes([0xA0 + n]) + raw
    k = 0 if n < 1 << 8 else 1 if n < 1 << 16 else 2
    return bytes([0xD9 + k]) + n.to_bytes(2**k, "big") + raw


@F.pandas_udf(BinaryType())
def entry_record(rows: pd.DataFrame) -> pd.Series:
    """An entry's record from a struct of LISTED; nulls are empty or 0, attributes go by name."""

    def one(values: tuple) -> bytes:
        *fields, attributes = values
        out = [_text((v or "").encode()) if n in TEXTS else _int(0 if v is None or v != v else int(v)) for n, v in zip(RECORD, fields)]
        pairs = [] if attributes is None or attributes != attributes else sorted(dict(attributes).items())
        return b"".join([*out, _int(len(pairs)), *(x for k, v in pairs for x in (_text(k.encode()), _text(bytes(v or b""))))])

    return pd.Series([one(x) for x in rows[[*RECORD, "attributes"]].itertuples(index=False)], dtype=object)


class _Records:
    """Records from bytes that come in pieces of any length."""

    def __init__(self) -> None:
        self.data, self.at, self.last = b"", 0, 0

    def _take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def _int(self) -> int:
        c = self._take(1)[0]
        if c < 0x80 or c >= 0xE0:
            return c if c < 0x80 else c - 256
        if 0xCC <= c <= 0xD3:
            return int.from_bytes(self._take(1 << (c & 3)), "big", signed=c >= 0xD0)
        raise ValueError(f"byte {c:#x} where a record has an integer")

    def _bytes(self) -> bytes:
        c = self._take(1)[0]
        if 0xA0 <= c < 0xC0:
            return self._take(c - 0xA0)
        width = {0xD9: 1, 0xDA: 2, 0xDB: 4, 0xC4: 1, 0xC5: 2, 0xC6: 4, 0xC0: 0}.get(c)
        if width is None:
            raise ValueError(f"byte {c:#x} where a record has a string")
        return self._take(int.from_bytes(self._take(width), "big"))

    def feed(self, data: bytes) -> Iterator[dict]:
        """The records that end in what has come so far; chunk numbers are absolute."""
        self.data, self.at = self.data[self.at :] + data, 0
        while self.at < len(self.data):
            begin = self.at
            try:
                r = {n: self._bytes().decode("utf-8", "replace") if n in TEXTS else self._int() for n in RECORD}
                r["attributes"] = [(self._bytes().decode("utf-8", "replace"), self._bytes()) for _ in range(self._int())] or None
            except EOFError:
                self.at = begin
                return
            if not r["mode"] & (MODE_DIR | MODE_LINK):
                r["start_chunk"] += self.last
                r["end_chunk"] += r["start_chunk"]
                self.last = r["end_chunk"]
            yield r

    def done(self) -> None:
        if self.at < len(self.data):
            raise ValueError("a listing ends within a record")


def read_records(parts: DataFrame) -> DataFrame:
    """Entries (LISTED) of the streams ``(id, seq, content)``, with ``id``; start and end chunks are decoded from their distances.

    A record's place is known only from those before it, so a stream is one task's; it is decoded a
    batch of parts at a time.  A stream that is cut off, or holds anything else, ends the job.
    """
    held = f"id string, {LISTED}"
    types = [pa.string(), *(pa.string() if n in TEXTS else pa.int64() for n in RECORD), pa.map_(pa.string(), pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stream, rows = None, None, []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(["id", *RECORD, "attributes"], types)], ["id", *RECORD, "attributes"])
            rows.clear()
            return made

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                if stream is None or name != now:
                    if stream is not None:
                        stream.done()
                    now, stream = name, _Records()
                for r in stream.feed(content.as_py() or b""):
                    rows.append({"id": name, **r})
                    if len(rows) >= BATCH:
                        yield out()
        if stream is not None:
            stream.done()
        if rows:
            yield out()

    return parts.select("id", "seq", "content").repartition("id").sortWithinPartitions("id", "seq").select("id", "content").mapInArrow(run, held)
