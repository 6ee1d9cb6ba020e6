"""The engine's commands over a storage of Parquet tables.

A storage is a folder that all executors see:

* ``config/<n>.json``, ``state/<n>.json``: numbered versions, each created exclusively; the highest one that
  is whole holds.  The config is sealed under a password if one was given;
* ``chunks``: ``chunk_id, size, upload, payload``, partitioned by the id's first byte; ``upload`` names the
  backup that wrote the row;
* ``entries``: files with their pieces of chunks, partitioned by id and revision;
* ``snapshots``: headers, partitioned by id.  A header is written last: it makes a revision exist.
  ``deleted`` lists those that no longer do; revision numbers aren't used twice;
* ``fossils``, ``resurrected``: rows of chunks by collection; ``incomplete``: what a stopped backup had done.

Chunks are named by the hash of their content, so a task or backup that runs twice writes nothing new.
Tables only grow by committed jobs.  A fossil is a row ``(chunk_id, upload)``: a backup that runs during a
collection writes a row of its own, which no collection before it can delete.  Rows are deleted by writing
what else their files hold anew, then removing the files; what stops in between leaves copies, no gaps.

Chunks are encrypted under a key each; entries and headers aren't.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, hashing
from ..functions.formats import parse_retention
from ..functions.paths import collation_key
from ..model import DAY, MODE_DIR, MODE_LINK, Config
from ..operators import chunking, filters, joins, prune, stats
from ..operators.ordering import cut, forget
from ..sources.repository import read_repository
from ..sources.storage import resolve

PIECE = "struct<seq:int,chunk_id:string,size:long,start:long,stop:long,at:long>"
ENTRY = f"path string, size long, time long, mode long, link string, uid int, gid int, attributes map<string,binary>, hash string, pieces array<{PIECE}>"
ENTRY_COLUMNS = ["path", "size", "time", "mode", "link", "uid", "gid", "attributes", "hash", "pieces"]
HEADER = "id string, revision int, tag string, options string, start_time long, end_time long, file_size long, number_of_files long"
HEADER_COLUMNS = [c.split()[0] for c in HEADER.split(", ")]
CHUNK = "chunk_id string, size long, upload string, payload binary, prefix string"
CHUNK_COLUMNS = ["chunk_id", "size", "upload", "payload", "prefix"]
FOSSIL = "chunk_id string, upload string, number int"
STREAMED = "kind string, path string, hash string, seq int, chunk_id string, size long, start long, stop long, at long, content binary"
#: Bytes read of a file at once, of a batch that goes back to the JVM, and of the files that a backup commits together.
WINDOW_BYTES, BATCH_BYTES, SLICE_BYTES = 4 << 20, 32 << 20, 256 << 30
ITERATIONS = 16384
KEYS = ("chunk_seed", "hash_key", "id_key", "chunk_key")


class WrongPassword(PermissionError):
    pass


def is_file(mode: str = "mode") -> Column:
    return F.col(mode).bitwiseAND(F.lit(MODE_DIR | MODE_LINK)) == 0


class Engine:
    """Commands on one storage."""

    def __init__(self, spark: SparkSession, url: str, password: str | None = None):
        self.spark = spark
        self.kind, self.path = resolve(url)
        self.config = self._load_config(password)

    # ------------------------------------------------------------ small files

    def _fs(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def _versions(self, name: str) -> list[int]:
        fs, folder = self._fs(name)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, name: str) -> dict | None:
        """The highest version that is whole; one that a crash cut short is passed over."""
        for n in reversed(self._versions(name)):
            fs, path = self._fs(f"{name}/{n:08}.json")
            stream = fs.open(path)
            try:
                return json.loads(bytes(stream.readAllBytes()))
            except ValueError:
                continue
            finally:
                stream.close()
        return None

    def _write(self, name: str, change: Callable[[dict | None], dict]) -> dict:
        """Create the next version; of two writers at once, one fails."""
        number = max([0, *self._versions(name)]) + 1
        value = change(self._read(name))
        fs, path = self._fs(f"{name}/{number:08}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise RuntimeError(f"another command has changed {name} of {self.path}") from e
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        return value

    @property
    def state(self) -> dict:
        return self._read("state") or {"next_collection": 1, "collections": []}

    def _change_state(self, change: Callable[[dict], dict]) -> dict:
        return self._write("state", lambda old: change(old or {"next_collection": 1, "collections": []}))

    # ------------------------------------------------------------ config

    def _aes(self, f: Callable, data: bytes, key: bytes) -> bytes | None:
        row = self.spark.createDataFrame([(bytearray(data), bytearray(key))], "d binary, k binary").select(f("d", "k", F.lit("GCM"))).first()
        return None if row[0] is None else bytes(row[0])

    def _sealed(self, config: Config, password: str | None, iterations: int) -> dict:
        held = {k: base64.b64encode(v).decode() if isinstance(v, bytes) else v for k, v in asdict(config).items()}
        if password is None:
            return held
        salt = os.urandom(32)
        sealed = self._aes(F.aes_encrypt, json.dumps(held).encode(), hashing.master_key(password, salt, iterations))
        return {"salt": base64.b64encode(salt).decode(), "iterations": iterations, "sealed": base64.b64encode(sealed).decode()}

    def _load_config(self, password: str | None) -> Config:
        held = self._read("config")
        if held is None:
            raise FileNotFoundError(f"no storage at {self.path}")
        if "sealed" in held:
            if password is None:
                raise WrongPassword(f"the storage at {self.path} has a password")
            opened = self._aes(F.try_aes_decrypt, base64.b64decode(held["sealed"]), hashing.master_key(password, base64.b64decode(held["salt"]), held["iterations"]))
            if opened is None:
                raise WrongPassword(f"wrong password for {self.path}")
            held = json.loads(opened)
        return Config(**{k: base64.b64decode(v) if k in KEYS else v for k, v in held.items()})

    @classmethod
    def init(cls, spark: SparkSession, url: str, config: Config | None = None, copy_from: Engine | None = None, password: str | None = None, iterations: int = ITERATIONS, bit_identical: bool = False) -> Engine:
        """Create a storage.

        With a password the config is sealed under it and chunks are encrypted under keys drawn at random.
        ``copy_from`` takes another storage's constants, so that chunks can be copied; with
        ``bit_identical`` its id and chunk keys too, so that they can be copied as they are (H13).
        """
        made = cls.__new__(cls)
        made.spark, (made.kind, made.path) = spark, resolve(url)
        if made._versions("config"):
            raise FileExistsError(f"there is a storage at {made.path}")
        if copy_from:
            config = replace(copy_from.config) if bit_identical else replace(copy_from.config, id_key=os.urandom(32) if password else copy_from.config.id_key, chunk_key=b"")
        elif password is not None:
            config = replace(config or Config(), hash_key=os.urandom(32), id_key=os.urandom(32), chunk_seed=os.urandom(32))
        config = config or Config()
        if password is not None and not config.chunk_key:
            config = replace(config, chunk_key=os.urandom(32))
        made._write("config", lambda _: made._sealed(config, password, iterations))
        made.config = config
        return made

    def change_password(self, password: str | None, iterations: int = ITERATIONS) -> None:
        """Seal the config under another password; chunks stay as they are."""
        if password is None and self.config.chunk_key:
            raise ValueError("an encrypted storage needs a password")
        self._write("config", lambda _: self._sealed(self.config, password, iterations))

    # ------------------------------------------------------------ tables

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _append(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(f"{self.path}/{name}")

    @property
    def snapshots(self) -> DataFrame:
        gone = self._table("deleted", "id string, revision int")
        return self._table("snapshots", HEADER).join(gone, ["id", "revision"], "left_anti")

    @property
    def entries(self) -> DataFrame:
        """Entries of revisions that exist."""
        return self._table("entries", f"{ENTRY}, id string, revision int").join(self.snapshots.select("id", "revision").distinct(), ["id", "revision"], "left_semi")

    @property
    def stored(self) -> DataFrame:
        return self._table("chunks", CHUNK)

    def _fossils(self, number: int | None = None) -> DataFrame:
        """Rows ``chunk_id, upload, number`` of collections that aren't settled, or of one, but for those that a check brought back."""
        numbers = [number] if number is not None else [c["number"] for c in self.state["collections"]]
        return self._table("fossils", FOSSIL).filter(F.col("number").isin(numbers)).join(self._table("resurrected", FOSSIL), ["chunk_id", "upload", "number"], "left_anti")

    @property
    def rows(self) -> DataFrame:
        """Stored rows without payload: ``chunk_id, upload, size, fossil``."""
        fossils = self._fossils().select("chunk_id", "upload").distinct().withColumn("fossil", F.lit(True))
        return self.stored.select("chunk_id", "upload", "size").join(fossils, ["chunk_id", "upload"], "left").fillna(False, ["fossil"])

    @property
    def chunks(self) -> DataFrame:
        """Stored chunks: ``chunk_id, size, state``; a chunk is a fossil if all its rows are."""
        held = self.rows.groupBy("chunk_id").agg(F.max("size").alias("size"), F.min("fossil").alias("fossil"))
        return held.select("chunk_id", "size", F.when(F.col("fossil"), "fossil").otherwise("chunk").alias("state"))

    @property
    def refs(self) -> DataFrame:
        return self.entries.select("id", "revision", "path", F.explode("pieces").alias("p")).select("id", "revision", "path", "p.seq", "p.chunk_id", "p.size")

    def snapshot(self, snapshot_id: str, revision: int | None = None) -> DataFrame:
        """Entries of a revision, the last by default."""
        if revision is None:
            revision = self.snapshots.filter(F.col("id") == snapshot_id).agg(F.max("revision")).first()[0]
        return self.entries.filter((F.col("id") == snapshot_id) & (F.col("revision") == revision))

    # ------------------------------------------------------------ chunks

    def _name(self) -> Callable[[bytes], str]:
        """A chunk's id by its content."""
        c = self.config
        return lambda part: hashing.keyed_hash(c.id_key, hashing.keyed_hash(c.hash_key, part, c.compression_level), c.compression_level).hex()

    def _key(self) -> Column | None:
        return codec.derived_key(F.col("chunk_id"), self.config.chunk_key) if self.config.chunk_key else None

    def _encoded(self, chunks: DataFrame, upload: str) -> DataFrame:
        """Rows of the chunk table for ``chunk_id, size, content``."""
        c = self.config
        payload = codec.encode_chunk(F.col("content"), c.compression_level, self._key(), (c.data_shards, c.parity_shards) if c.data_shards else None)
        return chunks.select("chunk_id", "size", F.lit(upload).alias("upload"), payload.alias("payload"), F.substring("chunk_id", 1, 2).alias("prefix"))

    def _decoded(self, rows: DataFrame) -> DataFrame:
        """``chunk_id, content`` of stored rows; null content where a row is damaged."""
        return rows.select("chunk_id", codec.decode_chunk(F.col("payload"), self._key(), bool(self.config.data_shards), strict=False).alias("content"))

    def _of_ids(self, ids: DataFrame) -> DataFrame:
        """One stored row for each of the distinct ids: only their payloads are shuffled."""
        return self.stored.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])

    def _streamed(self, files: DataFrame, top: str, pack: bool) -> DataFrame:
        """Listed files read where they are, window by window (STREAMED): a row for each file, piece of a file, and chunk."""
        c, name = self.config, self._name()
        names = [x.split()[0] for x in STREAMED.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in STREAMED.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stream = chunking.ChunkStream(c.average_chunk_size, c.max_chunk_size, c.min_chunk_size, c.chunk_seed, pack)
            rows, held = [], 0

            def take(chunks: Iterator[tuple[bytes, list[tuple]]]) -> None:
                nonlocal held
                for content, pieces in chunks:
                    own = name(content)
                    rows.append(("chunk", None, None, None, own, len(content), None, None, None, content))
                    rows.extend(("piece", path, None, seq, own, len(content), start, stop, at, None) for path, seq, start, stop, at in pieces)
                    held += len(content)

            def out() -> pa.RecordBatch:
                nonlocal held
                cols = list(zip(*rows))
                rows.clear()
                held = 0
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names)

            for b in batches:
                for path in b.column(0).to_pylist():
                    whole = hashing.file_hasher(c.compression_level)
                    with open(os.path.join(top, path), "rb") as f:
                        data = f.read(WINDOW_BYTES)
                        while data:
                            more = f.read(WINDOW_BYTES)
                            whole.update(data)
                            take(stream.feed(path, data, not more))
                            if held >= BATCH_BYTES:
                                yield out()
                            data = more
                    rows.append(("file", path, whole.hexdigest(), None, None, None, None, None, None, None))
            take(stream.close())
            if rows:
                yield out()

        return files.select("path").mapInArrow(run, STREAMED)

    # ------------------------------------------------------------ backup

    def backup(
        self, snapshot_id: str, folder: str, rules: list[str] | None = None, tag: str = "", marker: str = "", by_attribute: bool = False, hash_all: bool = False, pack: bool = False, dry_run: bool = False, slice_bytes: int = SLICE_BYTES
    ) -> dict:
        """Back a folder up as the id's next revision (L1).

        With ``hash_all`` unchanged files are read too; with ``pack`` small files share chunks.  Changed files are
        read in slices of about ``slice_bytes``, each of which is committed; a backup that was stopped
        goes on with the files that are left (T5).
        """
        started, top, upload = int(time.time()), os.path.abspath(folder), uuid.uuid4().hex
        listed = read_repository(self.spark, top)
        skipped = listed.filter("skip_reason IS NOT NULL").count()
        listed = listed.filter("skip_reason IS NULL")
        if rules:
            parsed = filters.parse_cli_rules(rules)
            # A directory that is excluded takes what is below it along.
            gone = listed.filter(F.col("path").endswith("/") & ~filters.rule_column(F.col("path"), parsed)).select(F.col("path").alias("gone"))
            listed = listed.filter(filters.rule_column(F.col("path"), parsed))
            above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"), F.lit("/")))
            inside = listed.select("path", F.explode(above).alias("gone")).join(gone, "gone", "left_semi").select("path").distinct()
            listed = listed.join(inside, "path", "left_anti")
        if marker:
            listed = filters.without_marked(listed, marker)
        if by_attribute:
            listed = filters.without_attribute(listed)
        listed = cut(listed)  # one listing for all that follows
        if listed.isEmpty():
            raise ValueError(f"{folder} has nothing to back up")
        every = self._table("snapshots", HEADER).filter(F.col("id") == snapshot_id)
        revision = (every.agg(F.max("revision")).first()[0] or 0) + 1
        files = listed.filter(is_file())
        old = self.snapshot(snapshot_id).filter(is_file()).select("path", "size", "time", "hash", "pieces")
        partial = f"incomplete/id={snapshot_id}"
        begun = self._table(partial, "path string, size long, time long, hash string, pieces array<" + PIECE + ">")
        # Of a stopped backup, files all of whose chunks are there.
        lost = begun.select("path", F.explode("pieces").alias("p")).select("path", "p.chunk_id").join(self.chunks.filter("state = 'chunk'"), "chunk_id", "left_anti").select("path").distinct()
        begun = begun.join(lost, "path", "left_anti").dropDuplicates(["path", "size", "time"])
        old = old.limit(0) if hash_all else old
        old = cut(begun.unionByName(old.join(begun.select("path"), "path", "left_anti")))
        compared = cut(joins.backup_compare(files.select("path", "size", "time"), old))
        changed = compared.filter("action <> 'preserved'").join(files.select("path", "time"), "path")
        todo = changed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        totals = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        out = {"id": snapshot_id, "revision": revision, "files": totals["n"], "bytes": totals["bytes"], "changed_files": todo["n"], "chunks": 0, "new_chunks": 0, "new_bytes": 0, "skipped": skipped, "resumed_files": begun.count()}
        if dry_run:
            return out
        slices = max(1, -(-todo["bytes"] // slice_bytes))
        for k in range(slices):
            part = changed.filter(F.pmod(F.xxhash64("path"), F.lit(slices)) == k)
            got = self._upload(part, top, pack, upload)
            for name in ("chunks", "new_chunks", "new_bytes"):
                out[name] += got[name]
            self._append(got["content"], partial)
            forget(got["streamed"])
        content = self._table(partial, "path string, size long, time long, hash string, pieces array<" + PIECE + ">").dropDuplicates(["path", "size", "time"])
        kept = compared.filter("action = 'preserved'").select("path").join(old, "path").select("path", "hash", "pieces")
        fresh = content.join(changed.select("path", "size", "time"), ["path", "size", "time"]).select("path", "hash", "pieces")
        rows = listed.drop("skip_reason").join(fresh.unionByName(kept), "path", "left").select(*ENTRY_COLUMNS, F.lit(snapshot_id).alias("id"), F.lit(revision).alias("revision"))
        self._entries(rows)
        self._header([(snapshot_id, revision, tag, "", started, int(time.time()), totals["bytes"], totals["n"])])
        fs, path = self._fs(partial)
        fs.delete(path, True)
        return out

    def _upload(self, files: DataFrame, top: str, pack: bool, upload: str) -> dict:
        """Write the chunks of ``path, size, time`` that the storage lacks."""
        streamed = cut(self._streamed(files, top, pack))
        made = streamed.filter("kind = 'chunk'").select("chunk_id", "size", "content")
        fresh = joins.new_chunks(made, self.chunks.filter("state = 'chunk'"))
        told = fresh.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        if told["n"]:
            self._append(self._encoded(fresh, upload), "chunks", "prefix")
        # Empty files have no piece.
        pieces = streamed.filter("kind = 'piece'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "size", "start", "stop", "at"))).alias("pieces"))
        own = streamed.filter("kind = 'file'").select("path", "hash").join(pieces, "path", "left")
        content = own.join(files.select("path", "size", "time"), "path").select("path", "size", "time", "hash", "pieces")
        return {"chunks": made.count(), "new_chunks": told["n"], "new_bytes": told["bytes"], "content": content, "streamed": streamed}

    def _entries(self, rows: DataFrame) -> None:
        """Write revisions' entries; those of a try that got no header are replaced."""
        rows.select(*ENTRY_COLUMNS, "id", "revision").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id", "revision").parquet(f"{self.path}/entries")

    def _header(self, rows: list[tuple]) -> None:
        self._append(self.spark.createDataFrame(rows, HEADER).coalesce(1), "snapshots", "id")

    # ------------------------------------------------------------ queries

    def list(self, snapshot_id: str | None = None, tag: str | None = None, revisions: list[int] | None = None) -> DataFrame:
        s = self.snapshots
        s = s.filter(F.col("id") == snapshot_id) if snapshot_id else s
        s = s.filter(F.col("tag") == tag) if tag else s
        return (s.filter(F.col("revision").isin(revisions)) if revisions else s).orderBy("id", "revision")

    def files(self, snapshot_id: str, revision: int | None = None) -> DataFrame:
        """A revision's entries in the order of directories."""
        return self.snapshot(snapshot_id, revision).orderBy(collation_key(F.col("path")))

    def _wanted_refs(self, snapshot_id: str | None, tag: str | None, revisions: list[int] | None) -> DataFrame:
        chosen = self.list(snapshot_id, tag, revisions).select("id", "revision")
        return self.refs.select("id", "revision", "chunk_id").join(chosen, ["id", "revision"], "left_semi")

    def check(self, snapshot_id: str | None = None, tag: str | None = None, revisions: list[int] | None = None, statistics: bool = False, resurrect: bool = False) -> DataFrame:
        """Missing and fossil chunks of the chosen revisions; with ``statistics`` the table of total, unique and new chunks.

        With ``resurrect`` fossils that a chosen revision needs are chunks again (K9).
        """
        refs = self._wanted_refs(snapshot_id, tag, revisions)
        if resurrect:
            needed = refs.select("chunk_id").distinct().join(self.chunks.filter("state = 'fossil'"), "chunk_id", "left_semi")
            self._fossils().join(needed, "chunk_id", "left_semi").select("chunk_id", "upload", "number").write.mode("append").parquet(f"{self.path}/resurrected")
        return stats.tabular_stats(refs, self.chunks) if statistics else joins.check_chunks(refs, self.chunks)

    def verify(self, again: bool = False) -> DataFrame:
        """Decode chunks that weren't verified before, recompute their ids, and note the good ones (V3, J18, T10): ``chunk_id, good``."""
        todo = self.stored if again else self.stored.join(self._table("verified", "chunk_id string, verified_at long").select("chunk_id"), "chunk_id", "left_anti")
        name = self._name()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({"chunk_id": pa.array(names, pa.string()), "good": pa.array([x.is_valid and name(x.as_buffer().to_pybytes()) == n for n, x in zip(names, b.column(1))], pa.bool_())})

        found = cut(self._decoded(todo).mapInArrow(run, "chunk_id string, good boolean"))
        found.filter("good").select("chunk_id", F.lit(int(time.time())).cast("long").alias("verified_at")).write.mode("append").parquet(f"{self.path}/verified")
        return found

    def _pieces(self, entries: DataFrame) -> DataFrame:
        """``path, hash, seq, chunk_id, at, size, content`` of entries' files; null content where a chunk is missing or damaged."""
        p = entries.select("path", "hash", F.explode_outer("pieces").alias("p")).select("path", "hash", "p.seq", "p.chunk_id", "p.start", "p.stop", "p.at")
        held = self._decoded(self._of_ids(p.filter("chunk_id IS NOT NULL")))
        part = F.substring("content", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
        return p.join(held, "chunk_id", "left").select("path", "hash", "seq", "chunk_id", "at", (F.col("stop") - F.col("start")).alias("size"), part.alias("content"))

    def verify_files(self, snapshot_id: str, revision: int | None = None) -> DataFrame:
        """``path, good`` of a revision's files: put together from their chunks and hashed, a chunk at a time (V1)."""
        level = self.config.compression_level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, whole, wanted = None, None, True, None
            for b in batches:
                out = []
                for path, hash_, seq, content in zip(*(b.column(i) for i in range(4))):
                    if path.as_py() != now:
                        if held is not None:
                            out.append((now, whole and held.hexdigest() == wanted))
                        now, wanted, whole, held = path.as_py(), hash_.as_py(), True, hashing.file_hasher(level)
                    if content.is_valid:
                        held.update(content.as_buffer())
                    elif seq.is_valid:
                        whole = False
                if out:
                    yield pa.RecordBatch.from_pydict({"path": [p for p, _ in out], "good": [g for _, g in out]})
            if held is not None:
                yield pa.RecordBatch.from_pydict({"path": [now], "good": [whole and held.hexdigest() == wanted]})

        laid = self._pieces(self.snapshot(snapshot_id, revision).filter("hash IS NOT NULL")).repartition("path").sortWithinPartitions("path", "seq")
        return laid.select("path", "hash", "seq", "content").mapInArrow(run, "path string, good boolean")

    def damage(self, snapshot_id: str, revision: int | None = None) -> DataFrame:
        """One row: a revision's files, and how many of them can't be put together as they were."""
        return self.verify_files(snapshot_id, revision).agg(F.count("*").alias("n_files"), F.coalesce(F.sum((~F.col("good")).cast("long")), F.lit(0)).alias("n_corrupted"))

    def cat(self, snapshot_id: str, path: str, revision: int | None = None) -> bytes:
        """A file's bytes; only its own chunks are read."""
        found = self.snapshot(snapshot_id, revision).filter((F.col("path") == path) & F.col("hash").isNotNull())
        parts, wanted = [], None
        for r in self._pieces(found).orderBy("seq").toLocalIterator():
            if r.content is None and r.seq is not None:
                raise ValueError(f"chunk {r.chunk_id} of {path} is missing or damaged")
            parts.append(bytes(r.content or b""))
            wanted = r.hash
        if wanted is None:
            raise FileNotFoundError(path)
        data = b"".join(parts)
        if hashing.file_hash(data, self.config.compression_level) != wanted:
            raise ValueError(f"{path} has another hash than recorded")
        return data

    def diff(self, snapshot_id: str, left: int, right: int | str) -> DataFrame:
        """Files that differ between two revisions, or between one and a folder on disk."""
        side = lambda df: df.filter("hash IS NOT NULL").select("path", "size", "hash")
        if isinstance(right, int):
            return joins.snapshot_diff(side(self.snapshot(snapshot_id, left)), side(self.snapshot(snapshot_id, right)))
        top, level = os.path.abspath(right), self.config.compression_level

        @F.pandas_udf("string")
        def hash_of(paths):
            def one(path: str) -> str:
                whole = hashing.file_hasher(level)
                with open(os.path.join(top, path), "rb") as f:
                    while part := f.read(WINDOW_BYTES):
                        whole.update(part)
                return whole.hexdigest()

            return paths.map(one)

        there = read_repository(self.spark, top).filter("skip_reason IS NULL").filter(is_file())
        return joins.snapshot_diff(side(self.snapshot(snapshot_id, left)), there.select("path", "size", hash_of("path").alias("hash")))

    def diff_file(self, snapshot_id: str, path: str, left: int, right: int) -> list[str]:
        """Lines of a file that differ, with three lines around them."""
        import difflib

        a, b = (self.cat(snapshot_id, path, r).decode("utf-8", "replace").splitlines() for r in (left, right))
        return list(difflib.unified_diff(a, b, f"{path}@{left}", f"{path}@{right}", lineterm=""))

    def history(self, snapshot_id: str, path: str) -> DataFrame:
        """Every revision with the file's size, time and hash, and whether it changed."""
        file = self.entries.filter((F.col("id") == snapshot_id) & (F.col("path") == path)).select("revision", "size", "time", "hash")
        all_revisions = self.snapshots.filter(F.col("id") == snapshot_id).select("id", "revision")
        return joins.history(all_revisions.join(file, "revision", "left"), ["id"])

    def info(self) -> dict:
        c = self.config
        return {
            "path": self.path, "average": c.average_chunk_size, "largest": c.max_chunk_size, "smallest": c.min_chunk_size, "compression": c.compression_level, "erasure": f"{c.data_shards}:{c.parity_shards}",
            "encrypted": bool(c.chunk_key), "ids": [r.id for r in self.snapshots.select("id").distinct().orderBy("id").collect()],
        }

    # ------------------------------------------------------------ restore

    def restore(self, snapshot_id: str, folder: str, revision: int | None = None, rules: list[str] | None = None, overwrite: bool = False, delete: bool = False, set_owner: bool = False, reuse: bool = True) -> dict:
        """Bring a folder to a revision (L2): files that are the same are passed over, others written piece by piece, verified and put in place.

        With ``reuse`` pieces that the file's present version holds, at any offset, are taken from it and not from the storage (K4, J16).
        """
        top, level = os.path.abspath(folder), self.config.compression_level
        os.makedirs(top, exist_ok=True)
        wanted = self.snapshot(snapshot_id, revision)
        if rules:
            wanted = wanted.filter(filters.rule_column(F.col("path"), filters.parse_cli_rules(rules)))
        wanted = cut(wanted)
        local = cut(read_repository(self.spark, top).filter("skip_reason IS NULL"))
        actions = cut(joins.restore_plan(wanted.filter("hash IS NOT NULL"), local.filter(is_file())))
        todo = actions.filter("action = 'restore'").select("path")
        there = todo.join(local.filter(is_file()).select("path"), "path", "left_semi")
        if not overwrite and (first := there.take(1)):
            raise FileExistsError(f"{first[0].path} differs; it takes overwrite")

        def each(f: Callable[..., None]):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for row in zip(*(c.to_pylist() for c in b.columns)):
                        f(*row)
                    yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

            return lambda df: df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

        def own(full: str, uid: int | None, gid: int | None, attributes: list | None) -> None:
            for k, v in attributes or []:
                with contextlib.suppress(OSError):  # a file system may have none
                    os.setxattr(full, f"user.{k}", v, follow_symlinks=False)
            if set_owner and uid is not None:
                os.chown(full, uid, gid, follow_symlinks=False)

        each(lambda path: os.makedirs(os.path.join(top, path), exist_ok=True))(wanted.filter(F.col("mode").bitwiseAND(F.lit(MODE_DIR)) != 0).select("path"))
        pieces = wanted.join(todo, "path", "left_semi")
        reused = 0
        found = self._pieces(pieces).withColumn("old", F.lit(None).cast("long"))
        if reuse and overwrite and not there.isEmpty():
            have = cut(self._streamed(there, top, False).filter("kind = 'piece'").groupBy("path", "chunk_id").agg(F.min("at").alias("old")))
            split = pieces.select("path", "hash", F.explode_outer("pieces").alias("p")).join(have.withColumnRenamed("path", "__p"), (F.col("path") == F.col("__p")) & (F.col("p.chunk_id") == F.col("chunk_id")), "left").drop("__p", "chunk_id")
            split = cut(split)
            mine = split.filter("old IS NOT NULL AND p.start = 0 AND p.stop = p.size")
            reused = mine.count()
            rest = split.filter("old IS NULL OR p.start <> 0 OR p.stop <> p.size")
            # A file without a piece of its own left keeps its row.
            rest = rest.groupBy("path").agg(F.first("hash").alias("hash"), F.array_sort(F.collect_list("p")).alias("pieces"))
            found = self._pieces(rest).withColumn("old", F.lit(None).cast("long")).unionByName(
                mine.select("path", "hash", "p.seq", "p.chunk_id", "p.at", F.col("p.size").alias("size"), F.lit(None).cast("binary").alias("content"), "old")
            )
        meta = wanted.select("path", "mode", "time", "uid", "gid", F.map_entries("attributes").alias("attributes"))
        laid = found.join(meta, "path").repartition("path").sortWithinPartitions("path", "seq")

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, out, target, part, source, whole, good, last = None, [], None, None, None, None, True, None

            def finish() -> None:
                target.close()
                if source is not None:
                    source.close()
                done = good and whole.hexdigest() == last["hash"]
                if done:
                    os.chmod(part, last["mode"] & 0o777)
                    own(part, last["uid"], last["gid"], [(x["key"], x["value"]) for x in last["attributes"] or []])
                    os.utime(part, (last["time"], last["time"]))
                    os.replace(part, os.path.join(top, now))
                else:
                    os.remove(part)
                out.append((now, done))

            for b in batches:
                for i in range(b.num_rows):
                    row = {n: b.column(n)[i] for n in ("path", "seq", "content", "old", "size")}
                    if row["path"].as_py() != now:
                        if now is not None:
                            finish()
                        now, good, whole = row["path"].as_py(), True, hashing.file_hasher(level)
                        last = {n: b.column(n)[i].as_py() for n in ("hash", "mode", "time", "uid", "gid", "attributes")}
                        full = os.path.join(top, now)
                        os.makedirs(os.path.dirname(full), exist_ok=True)
                        part = f"{full}.{uuid.uuid4().hex[:8]}.part"
                        target, source = open(part, "wb"), open(full, "rb") if os.path.isfile(full) else None
                    if row["old"].is_valid:
                        source.seek(row["old"].as_py())
                        data = source.read(row["size"].as_py())
                    elif row["content"].is_valid:
                        data = row["content"].as_buffer()
                    else:
                        good = good and not row["seq"].is_valid  # an empty file has no piece
                        continue
                    whole.update(data)
                    target.write(data)
                if out:
                    yield pa.RecordBatch.from_pydict({"path": [p for p, _ in out], "good": [g for _, g in out]})
                    out.clear()
            if now is not None:
                finish()
                yield pa.RecordBatch.from_pydict({"path": [p for p, _ in out], "good": [g for _, g in out]})

        done = cut(laid.select("path", "hash", "seq", "content", "old", "size", "mode", "time", "uid", "gid", "attributes").mapInArrow(put, "path string, good boolean"))
        failed = [r.path for r in done.filter("not good").collect()]
        each(lambda path, link: os.path.lexists(os.path.join(top, path)) or os.symlink(link, os.path.join(top, path)))(wanted.filter("link IS NOT NULL").select("path", "link"))
        extra = each(lambda path: os.remove(os.path.join(top, path)))(actions.filter("action = 'extra'").select("path")) if delete and not rules else 0
        return {"restored": done.filter("good").count(), "skipped": actions.filter("action = 'skip'").count(), "failed": failed, "deleted": extra, "reused_chunks": reused}

    # ------------------------------------------------------------ copy and prune

    def copy_to(self, other: Engine, snapshot_id: str | None = None, revisions: list[int] | None = None) -> dict:
        """Copy snapshots, and the chunks that the other storage lacks, under its own ids, keys and codec; headers last."""
        if not self.config.compatible_with(other.config):
            raise ValueError("the storages' constants differ")
        mine, theirs = self.config, other.config
        heads = cut(self.list(snapshot_id, revisions=revisions).join(other._table("snapshots", HEADER).select("id", "revision"), ["id", "revision"], "left_anti"))
        rows = cut(self.entries.join(heads.select("id", "revision"), ["id", "revision"], "left_semi"))
        needed = rows.select(F.explode("pieces").alias("p")).select("p.chunk_id").distinct()
        upload = uuid.uuid4().hex
        same = (mine.id_key, mine.chunk_key, mine.compression_level, mine.data_shards, mine.parity_shards) == (theirs.id_key, theirs.chunk_key, theirs.compression_level, theirs.data_shards, theirs.parity_shards)
        if same:
            todo = cut(joins.copy_plan(needed, other.chunks.filter("state = 'chunk'")))
            content = self._of_ids(todo.filter("action = 'copy'")).select("chunk_id", "size", F.lit(upload).alias("upload"), "payload", "prefix")
        else:
            name = other._name()

            @F.pandas_udf("string")
            def renamed(contents):
                return contents.map(lambda x: None if x is None else name(bytes(x)))

            opened = self._of_ids(needed).select("size", "chunk_id", codec.decode_chunk(F.col("payload"), self._key(), bool(mine.data_shards)).alias("content"))
            opened = cut(opened.withColumn("new_id", renamed("content")))
            todo = cut(joins.copy_plan(opened.select(F.col("new_id").alias("chunk_id")), other.chunks.filter("state = 'chunk'")))
            fresh = opened.select(F.col("new_id").alias("chunk_id"), "size", "content").join(todo.filter("action = 'copy'"), "chunk_id", "left_semi")
            content = other._encoded(fresh.dropDuplicates(["chunk_id"]), upload)
            piece = F.struct("p.seq", F.col("new_id").alias("chunk_id"), "p.size", "p.start", "p.stop", "p.at")
            moved = rows.select("id", "revision", "path", F.explode("pieces").alias("p")).join(opened.select(F.col("chunk_id").alias("old_id"), "new_id"), F.col("p.chunk_id") == F.col("old_id"))
            moved = moved.groupBy("id", "revision", "path").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
            rows = rows.drop("pieces").join(moved, ["id", "revision", "path"], "left")
        other._append(content.select(*CHUNK_COLUMNS), "chunks", "prefix")
        other._entries(rows)
        n = heads.count()
        other._append(heads.select(*HEADER_COLUMNS).coalesce(1), "snapshots", "id")
        counts = {r.action: r["count"] for r in todo.groupBy("action").count().collect()}
        return {"snapshots": n, "copied": counts.get("copy", 0), "skipped": counts.get("skip", 0)}

    def prune(
        self, retention: list[str] | None = None, tags: list[str] | None = None, revisions: dict[str, list[int]] | None = None, exhaustive: bool = False, exclusive: bool = False, ignored: list[str] | None = None, now: int | None = None,
        dry_run: bool = False, collect_only: bool = False, delete_only: bool = False, ids: list[str] | None = None,
    ) -> dict:
        """Two-step fossil collection (L3): settle earlier collections, mark snapshots, list the chunks that only they need.

        Retention and tags mark snapshots of ``ids`` alone, of every id without them.  ``collect_only`` leaves earlier collections, ``delete_only`` makes no new one.
        """
        now = now or int(time.time())
        out = {"deleted_snapshots": 0, "fossils": 0, "deleted_chunks": 0, "resurrected": 0}
        if not collect_only:
            for c in self.state["collections"]:
                self._settle(c, exclusive, ignored, now, out, dry_run)
        s = self.snapshots
        of_ids = s.filter(F.col("id").isin(ids)) if ids else s
        if revisions:
            marked = self.spark.createDataFrame([(i, r) for i, rs in revisions.items() for r in rs], "id string, revision int").join(s, ["id", "revision"], "left_semi")
        elif retention:
            marked = prune.retention(of_ids, parse_retention(retention), now, tags, exclusive).filter("deleted").select("id", "revision")
        elif tags:
            marked = of_ids.filter(F.col("tag").isin(tags)).select("id", "revision")
        else:
            marked = s.select("id", "revision").limit(0)
        marked = cut(marked)
        if not exclusive:
            tops = prune.last_revisions(s).withColumnRenamed("last_revision", "revision")
            if not marked.join(tops, ["id", "revision"], "left_semi").isEmpty():
                raise ValueError("the last revision of an id can only be deleted exclusively")
        n = marked.count()
        if delete_only or not n and not exhaustive:
            return out
        refs = self.refs.select("id", "revision", "chunk_id")
        kept = refs.join(marked, ["id", "revision"], "left_anti")
        if exhaustive:
            objects = self.chunks.withColumn("name", F.col("chunk_id"))
            unused = prune.classify_objects(objects, kept).filter("action IN ('fossilize', 'collect_fossil')").select("chunk_id")
        else:
            unused = prune.unreferenced_chunks(refs.join(marked, ["id", "revision"], "left_semi"), kept)
        out |= {"deleted_snapshots": n}
        if dry_run:
            return out | {"fossils": unused.count()}
        number = self.state["next_collection"]
        fossils = cut(self.rows.filter("not fossil").join(unused, "chunk_id", "left_semi").select("chunk_id", "upload", F.lit(number).alias("number")).distinct())
        out["fossils"] = fossils.select("chunk_id").distinct().count()
        fossils.write.mode("append").parquet(f"{self.path}/fossils")
        collection = {"number": number, "end_time": now, "last_revisions": {r.id: r.last_revision for r in prune.last_revisions(s).collect()}, "deleted_revisions": [[r.id, r.revision] for r in marked.collect()]}
        # The manifest is saved before headers go.
        self._change_state(lambda st: {**st, "next_collection": number + 1, "collections": [*st["collections"], collection]})
        if n:
            marked.coalesce(1).write.mode("append").parquet(f"{self.path}/deleted")
        if exclusive:
            self._settle(collection, True, ignored, now, out, dry_run)
        return out

    def _settle(self, collection: dict, exclusive: bool, ignored: list[str] | None, now: int, out: dict, dry_run: bool) -> bool:
        """Delete or resurrect a collection's fossils, if every host has moved on since."""
        s, number = self.snapshots, collection["number"]
        listed = self.spark.createDataFrame([tuple(x) for x in collection["deleted_revisions"]] or [("", -1)], "id string, revision int")
        recorded = self.spark.createDataFrame(list(collection["last_revisions"].items()) or [("", 0)], "id string, last_revision int")
        ghost = not prune.ghost_snapshots(listed, s).isEmpty()
        if not ghost and not exclusive and not prune.is_deletable(s, recorded, collection["end_time"], now, self.kind.consistent, ignored).first()[0]:
            return False
        if dry_run:
            return True
        if not ghost:
            fossils = cut(self._fossils(number))
            # All snapshots that exist count: a fossil that any of them needs comes back, unless a later upload has its content too.
            again = self.rows.filter("not fossil").select("chunk_id").distinct()
            settled = cut(prune.settle_fossils(fossils, self.refs.select("chunk_id").join(again, "chunk_id", "left_anti")))
            counts = {r.action: r["count"] for r in settled.groupBy("action").count().collect()}
            out["deleted_chunks"] += counts.get("delete", 0)
            out["resurrected"] += counts.get("resurrect", 0)
            if counts.get("delete"):
                self._delete_rows(fossils.join(settled.filter("action = 'delete'"), "chunk_id", "left_semi").select("chunk_id", "upload"))
        # The collection goes last: what was stopped before is done again.
        self._change_state(lambda st: {**st, "collections": [c for c in st["collections"] if c["number"] != number]})
        return True

    def _delete_rows(self, gone: DataFrame) -> None:
        """Delete stored rows: what else their files hold is written anew, then these files go.  No other file is touched."""
        held = self.stored.withColumn("file", F.col("_metadata.file_path"))
        touched = cut(held.join(gone, ["chunk_id", "upload"], "left_semi").select("file").distinct())
        left = held.join(touched, "file", "left_semi").join(gone, ["chunk_id", "upload"], "left_anti").select(*CHUNK_COLUMNS)
        self._append(left, "chunks", "prefix")
        for r in touched.toLocalIterator():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(r.file))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)

    # ------------------------------------------------------------ benchmark

    def benchmark(self, size: int = 64 << 20) -> dict:
        """Seconds and MB a second of chunking, hashing and compressing ``size`` random bytes on one core."""
        data, c, out = os.urandom(size), self.config, {}

        def clock(name: str, f) -> None:
            t = time.perf_counter()
            f()
            out[name] = round(size / 1e6 / (time.perf_counter() - t), 1)

        clock("split_mb_s", lambda: chunking.cut_points(data, c.average_chunk_size, c.max_chunk_size, c.min_chunk_size, c.chunk_seed))
        clock("hash_mb_s", lambda: hashlib.blake2b(data, digest_size=32).digest())
        clock("compress_mb_s", lambda: codec.compress(data, c.compression_level))
        return out


def due(now: int, days: int = prune.DORMANT_DAYS) -> int:
    """The end time before which a host counts as dormant."""
    return now - days * DAY
