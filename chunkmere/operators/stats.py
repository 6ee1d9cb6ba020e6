"""Deduplication statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import shuffled


def storage_totals(chunks: DataFrame) -> DataFrame:
    """Objects and bytes by state; empty ones counted apart."""
    return chunks.groupBy("state").agg(
        F.count("*").alias("n_chunks"), F.sum("size").alias("bytes"), F.sum((F.col("size") == 0).cast("long")).alias("n_empty")
    )


def bag_totals(refs: DataFrame) -> DataFrame:
    """One row: references as a bag, their distinct chunks and ids."""
    held = refs.groupBy("id", "chunk_id").agg(F.count("*").alias("n"))
    return held.agg(F.sum("n").alias("n_refs"), F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("id").alias("n_ids"))


def revision_stats(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per (id, revision): distinct, unique and new chunks and their bytes.

    Unique: no other revision of any id refers to it.  New: no earlier revision of its id does.
    A missing chunk counts with no bytes.  Sizes are joined to the distinct references, whose
    partitioning by chunk then serves both windows; a chunk has at most one row a revision there.
    """
    size = F.coalesce("size", F.lit(0))
    seen = refs.select("id", "revision", "chunk_id").distinct().join(shuffled(chunks.select("chunk_id", "size")), "chunk_id", "left")
    alone = F.count("*").over(Window.partitionBy("chunk_id")) == 1
    new = F.col("revision") == F.min("revision").over(Window.partitionBy("chunk_id", "id"))
    told = seen.select("id", "revision", size.alias("size"), alone.alias("alone"), new.alias("new"))
    when = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    return told.groupBy("id", "revision").agg(
        F.count("*").alias("total_chunks"), F.sum("size").alias("total_bytes"), when(F.col("alone"), F.lit(1).cast("long")).alias("unique_chunks"), when(F.col("alone"), F.col("size")).alias("unique_bytes"),
        when(F.col("new"), F.lit(1).cast("long")).alias("new_chunks"), when(F.col("new"), F.col("size")).alias("new_bytes"),
    )


def id_stats(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per id: distinct chunks, and those that no other id refers to (A5, A6's ``all`` row)."""
    size = F.coalesce("size", F.lit(0))
    seen = refs.select("id", "chunk_id").distinct().join(shuffled(chunks.select("chunk_id", "size")), "chunk_id", "left")
    told = seen.select("id", size.alias("size"), (F.count("*").over(Window.partitionBy("chunk_id")) == 1).alias("own"))
    return told.groupBy("id").agg(
        F.count("*").alias("total_chunks"), F.sum("size").alias("total_bytes"), F.sum(F.col("own").cast("long")).alias("unique_chunks"), F.sum(F.when(F.col("own"), F.col("size")).otherwise(0)).alias("unique_bytes")
    )


def tabular_stats(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Revision rows and an ``all`` row (null revision) per id; not a rollup, since unique differs by level."""
    by_id = id_stats(refs, chunks).select("id", F.lit(None).cast("int").alias("revision"), "total_chunks", "total_bytes", "unique_chunks", "unique_bytes", F.lit(None).cast("long").alias("new_chunks"), F.lit(None).cast("long").alias("new_bytes"))
    return revision_stats(refs, chunks).withColumn("revision", F.col("revision").cast("int")).unionByName(by_id)


def file_list_stats(entries: DataFrame) -> DataFrame:
    """Per (id, revision): files, their bytes, and content chunks by the largest end chunk."""
    return entries.groupBy("id", "revision").agg(
        F.count("*").alias("n_files"), F.sum("size").alias("bytes"), (F.max("end_chunk") + 1).alias("n_chunks"), F.max(F.length(F.col("size").cast("string"))).alias("size_width")
    )


def dedup_ratio(chunks: DataFrame, hash_col: str = "hash", size_col: str = "size") -> DataFrame:
    """One row: chunks and bytes, all and distinct."""
    by_hash = chunks.groupBy(hash_col).agg(F.count("*").alias("n"), F.max(size_col).alias("size"))
    return by_hash.agg(F.sum("n").alias("n_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.count("*").alias("distinct_chunks"), F.sum("size").alias("distinct_bytes"))
