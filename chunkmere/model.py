"""The relational model: snapshots, entries, references, chunks; and views of it over the test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.joins import shuffled

ENTRIES = (
    "id string, revision int, seq long, path binary, size long, time long, mode long, link string, hash string, uid int, gid int, "
    "content struct<start_chunk:int,start_offset:int,end_chunk:int,end_offset:int>, attributes map<string,binary>"
)
SNAPSHOTS = (
    "version int, id string, revision int, options string, tag string, start_time long, end_time long, file_size long, number_of_files long, "
    "files array<string>, chunks array<string>, lengths array<string>"
)
REFS = "id string, revision int, kind string, seq int, hash string, length int"
CHUNKS = "chunk_id string, size long, state string, path string, payload binary"
COLLECTIONS = (
    "number int, end_time long, last_revisions map<string,int>, deleted_revisions map<string,array<int>>, fossils array<string>, temporaries array<string>"
)
VERIFIED = "chunk_id string, verified_at long"

DAY = 86_400
#: Bits of a Go file mode: directory, symbolic link, and all type bits.
MODE_DIR, MODE_LINK, MODE_TYPE = 1 << 31, 1 << 27, 0x8F280000


@dataclass(frozen=True)
class Config:
    """Constants of a storage (D9); sizes in bytes."""

    average_chunk_size: int = 4 << 20
    max_chunk_size: int = 16 << 20
    min_chunk_size: int = 1 << 20
    compression_level: int = 100
    chunk_seed: bytes = b"chunkmere"
    hash_key: bytes = b"chunkmere"
    id_key: bytes = b"chunkmere"
    chunk_key: bytes = b""  # chunks are encrypted if there is one
    data_shards: int = 0
    parity_shards: int = 0

    def __post_init__(self) -> None:
        if self.average_chunk_size & (self.average_chunk_size - 1):
            raise ValueError("the average chunk size must be a power of two")
        if not self.min_chunk_size <= self.average_chunk_size <= self.max_chunk_size:
            raise ValueError("chunk sizes must be in order")

    def compatible_with(self, other: Config) -> bool:
        """Chunks of one can be copied to the other."""
        mine = (self.average_chunk_size, self.max_chunk_size, self.min_chunk_size, self.chunk_seed, self.hash_key)
        return mine == (other.average_chunk_size, other.max_chunk_size, other.min_chunk_size, other.chunk_seed, other.hash_key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("repo"), (F.col("o_custkey") % 10).cast("string"), F.lit("@host"), (F.col("o_custkey") % 4).cast("string")).alias("id"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("revision"),
        F.unix_timestamp("o_orderdate").alias("at"),
        F.col("o_orderpriority").alias("tag"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as monthly snapshots of twenty ids: ``id, revision, start_time, end_time, tag``."""
    return _order_snapshots(spark, sf_dir).groupBy("id", "revision").agg(
        F.min("at").alias("start_time"), (F.max("at") + 3600).alias("end_time"), F.min("tag").alias("tag")
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as chunk references: ``id, revision, seq, chunk_id``."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_partkey") * 10 + F.col("l_quantity").cast("int") % 10).alias("chunk_id"),
    )
    return items.join(shuffled(_order_snapshots(spark, sf_dir).select("o_orderkey", "id", "revision")), "o_orderkey").select("id", "revision", "seq", "chunk_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as stored chunks, some lost: ``chunk_id, size, state``."""
    ids = table(spark, sf_dir, "part").select(F.explode(F.sequence(F.col("p_partkey") * 10, F.col("p_partkey") * 10 + 9)).alias("chunk_id"))
    return ids.filter("chunk_id % 53 <> 0").select(
        "chunk_id", (1024 + F.col("chunk_id") % 4096).alias("size"), F.when(F.col("chunk_id") % 17 == 0, "fossil").otherwise("chunk").alias("state")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: ``doc_id, path, content, size, hash``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"),
        F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("hash"),
    )


def remote_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a previous snapshot: ``path, size, time, hash``."""
    return files(spark, sf_dir).filter("doc_id % 10 <> 0").select("path", "size", (F.lit(1_700_000_000) + F.col("doc_id")).alias("time"), "hash")


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files later: some are gone, some longer, some touched."""
    own = files(spark, sf_dir).filter("doc_id % 7 <> 0")
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    time = F.lit(1_700_000_000) + F.col("doc_id") + F.when(F.col("doc_id") % 17 == 0, 2).when(F.col("doc_id") % 13 == 0, 1).otherwise(0)
    return own.select("path", F.octet_length(text).cast("long").alias("size"), time.alias("time"), F.sha2(text, 256).alias("hash"))
