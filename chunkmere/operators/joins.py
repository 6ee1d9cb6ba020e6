"""Comparisons of listings, snapshots and chunk sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(listing: DataFrame) -> DataFrame:
    """``listing``, shuffled where it is joined and never broadcast of Spark's own accord.

    Spark goes by an estimate from the bytes of files: it knows neither the rows that an explode makes nor
    what compression hides, and takes millions of chunks for less than its limit.
    """
    return listing.hint("merge")


def same_file(size_a: Column, time_a: Column, size_b: Column, time_b: Column) -> Column:
    """Equal sizes and times that differ by a second at most (P10)."""
    return (size_a == size_b) & (F.abs(time_a - time_b) <= 1)


def backup_compare(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Each local file: ``preserved`` if the last snapshot has the same, else ``modified`` or ``new``."""
    r = remote.select("path", F.col("size").alias("old_size"), F.col("time").alias("old_time"), F.lit(True).alias("known"))
    j = local.join(r, "path", "left")
    same = same_file(F.col("size"), F.col("time"), F.col("old_size"), F.col("old_time"))
    return j.select("path", "size", F.when(F.col("known").isNull(), "new").when(same, "preserved").otherwise("modified").alias("action"))


def restore_plan(snapshot: DataFrame, local: DataFrame) -> DataFrame:
    """Every path: ``restore``, ``skip`` (the same is there) or ``extra`` (not in the snapshot)."""
    s = snapshot.select("path", F.col("size").alias("s_size"), F.col("time").alias("s_time"), F.lit(True).alias("wanted"))
    have = local.select("path", F.col("size").alias("l_size"), F.col("time").alias("l_time"))
    same = same_file(F.col("s_size"), F.col("s_time"), F.col("l_size"), F.col("l_time"))
    action = F.when(F.col("wanted").isNull(), "extra").when(same, "skip").otherwise("restore")
    return s.join(have, "path", "full_outer").select("path", action.alias("action"), F.coalesce("s_size", "l_size").alias("size"))


def snapshot_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files that differ: removed (``-``), added (``+``) or changed (``*``); two empty files are the same."""
    side = lambda df, k: df.select("path", F.col("size").alias(f"{k}_size"), F.col("hash").alias(f"{k}_hash"), F.lit(True).alias(f"in_{k}"))
    j = side(left, "left").join(side(right, "right"), "path", "full_outer")
    same = F.col("left_hash").eqNullSafe(F.col("right_hash")) | ((F.col("left_size") == 0) & (F.col("right_size") == 0))
    mark = F.when(F.col("in_right").isNull(), "-").when(F.col("in_left").isNull(), "+").when(~same, "*")
    return j.select("path", mark.alias("change"), "left_size", "right_size").filter("change is not null")


def new_chunks(chunks: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Distinct chunks that aren't known yet: what a backup uploads."""
    return chunks.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def check_chunks(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per (id, revision): distinct chunks that are stored, only a fossil, or missing."""
    state = F.coalesce("state", F.lit("missing"))
    j = refs.select("id", "revision", "chunk_id").distinct().join(shuffled(chunks.select("chunk_id", "state")), "chunk_id", "left")
    count = lambda s: F.sum((state == s).cast("long")).alias
    return j.groupBy("id", "revision").agg(count("chunk")("n_ok"), count("fossil")("n_fossil"), count("missing")("n_missing"))


def missing_chunks(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Referenced chunks that aren't stored, with how many revisions need each."""
    gone = refs.select("id", "revision", "chunk_id").distinct().join(shuffled(chunks.select("chunk_id")), "chunk_id", "left_anti")
    return gone.groupBy("chunk_id").agg(F.count("*").alias("n_revisions"))


def latest(snapshots: DataFrame) -> DataFrame:
    """The last revision of each id, whole."""
    others = [c for c in snapshots.columns if c not in ("id", "revision")]
    top = snapshots.filter("revision > 0").groupBy("id").agg(F.max(F.struct("revision", *others)).alias("s"))
    return top.select("id", "s.*")


def history(versions: DataFrame, key: list[str], order: str = "revision", value: str = "hash") -> DataFrame:
    """Adds ``changed``: the value differs from that of the last version that exists."""
    before = F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    changed = F.when(F.col(value).isNull(), False).otherwise(~F.col(value).eqNullSafe(before))
    return versions.withColumn("changed", changed)


def copy_plan(refs: DataFrame, existing: DataFrame) -> DataFrame:
    """Distinct chunks of the source with what to do: ``copy`` or ``skip``."""
    have = existing.select("chunk_id").distinct().withColumn("have", F.lit(True))
    return refs.select("chunk_id").distinct().join(have, "chunk_id", "left").select("chunk_id", F.when(F.col("have"), "skip").otherwise("copy").alias("action"))


def first_occurrence(refs: DataFrame, group: list[str], key: str = "chunk_id", order: str = "seq") -> DataFrame:
    """Adds ``first_seq``, the least position in the group with the same key."""
    least = refs.groupBy(*group, key).agg(F.min(order).alias("first_seq"))
    return refs.join(least, [*group, key])


def aligned_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per path, bytes of the right version whose chunk at the same offset of the left one differs.

    Chunks are ``path, offset, size, hash``.  A differing chunk counts whole, and so does one that lies
    past the end of the other version.
    """
    other = left.select("path", "offset", F.col("hash").alias("old_hash"))
    changed = F.when(F.col("hash").eqNullSafe(F.col("old_hash")), 0).otherwise(F.col("size"))
    return right.join(other, ["path", "offset"], "left").groupBy("path").agg(F.sum(changed).alias("modified_bytes"), F.sum("size").alias("bytes"))


def reusable_chunks(needed: DataFrame, local: DataFrame, same_offset: bool = False) -> DataFrame:
    """Needed chunks that a local file has, anywhere or at the same offset."""
    keys = ["hash", "offset", "size"] if same_offset else ["hash"]
    return needed.join(local.select(*keys).distinct(), keys, "left_semi")
