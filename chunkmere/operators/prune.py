"""Retention and the two-step fossil collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import host_of
from ..model import DAY

#: A host without a new snapshot for so many days is safe; slack for stores that aren't consistent at once.
DORMANT_DAYS, SLACK = 7, DAY // 2


def retention(snapshots: DataFrame, policies: list[tuple[int, int]], now: int, tags: list[str] | None = None, exclusive: bool = False) -> DataFrame:
    """Adds ``deleted`` to snapshots, by (age, interval) policies in days, oldest first.

    A fold over each id's revisions in order carries the policy in force and the start of the last
    snapshot kept under it.  The last revision stays unless ``exclusive``; ids with one snapshot and
    rows with other tags are passed over.  Revisions of one id are few; ids are spread over tasks.
    """
    rule = F.array(*(F.struct(F.lit(a).alias("age"), F.lit(i).alias("every")) for a, i in policies)) if policies else None
    if rule is None:
        return snapshots.withColumn("deleted", F.lit(False))
    held = snapshots.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("revision", "start_time", "tag"))).alias("s"))
    # Whole days by the calendar: days are counted from the epoch in the session's time zone.
    held = held.withColumn("s", F.transform("s", lambda x, i: F.struct(x["revision"].alias("revision"), F.unix_date(F.to_date(F.timestamp_seconds(x["start_time"]))).alias("at"), (
        (F.lit(exclusive) | (i < F.size("s") - 1)) & (x["tag"].isin(tags) if tags else F.lit(True))).alias("open"))))
    today = F.unix_date(F.to_date(F.timestamp_seconds(F.lit(now))))

    def step(acc, x):
        # The first policy from the present one on that the snapshot is old enough for; their number if there is none.
        place = F.coalesce(F.array_min(F.filter(F.transform(rule, lambda r, k: F.when((k >= acc["rule"]) & (today - x["at"] >= r["age"]), k)), lambda k: k.isNotNull())), F.lit(len(policies)))
        every = F.try_element_at(rule, place + 1)["every"]
        last = F.when(place == acc["rule"], acc["kept"])
        gone = x["open"] & (place < len(policies)) & ((every == 0) | (last.isNotNull() & (x["at"] - last < every)))
        kept = F.when(~x["open"], acc["kept"]).when((place >= len(policies)) | gone, last).otherwise(x["at"])
        return F.struct(F.when(x["open"], place).otherwise(acc["rule"]).alias("rule"), kept.alias("kept"), F.concat(acc["out"], F.when(gone, F.array(x["revision"])).otherwise(F.array().cast("array<int>"))).alias("out"))

    start = F.struct(F.lit(0).alias("rule"), F.lit(None).cast("int").alias("kept"), F.array().cast("array<int>").alias("out"))
    gone = held.filter(F.size("s") > 1).select("id", F.explode(F.aggregate("s", start, step, lambda acc: acc["out"])).alias("revision")).withColumn("deleted", F.lit(True))
    return snapshots.join(gone, ["id", "revision"], "left").fillna(False, ["deleted"])


def unreferenced_chunks(deleted: DataFrame, kept: DataFrame) -> DataFrame:
    """Chunks of deleted snapshots that no kept one refers to."""
    return deleted.select("chunk_id").distinct().join(kept.select("chunk_id").distinct(), "chunk_id", "left_anti")


def classify_objects(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """What an exhaustive collection does with each stored object ``(name, chunk_id, state)``.

    ``tmp`` files are collected; a referenced fossil is resurrected, another collected; an unreferenced
    chunk becomes a fossil; a second copy of a referenced chunk is redundant; others are kept.
    """
    wanted = refs.select("chunk_id").distinct().withColumn("wanted", F.lit(True))
    copy = F.row_number().over(Window.partitionBy("chunk_id", "state").orderBy("name"))
    used = F.coalesce("wanted", F.lit(False))
    action = (
        F.when(F.col("state") == "unknown", "warn").when(F.col("state") == "tmp", "collect_tmp")
        .when((F.col("state") == "fossil") & used, "resurrect").when(F.col("state") == "fossil", "collect_fossil")
        .when(~used, "fossilize").when(F.col("copy") > 1, "delete_redundant").otherwise("keep")
    )
    return objects.join(wanted, "chunk_id", "left").withColumn("copy", copy).select("name", "chunk_id", "state", action.alias("action"))


def settle_fossils(fossils: DataFrame, new_refs: DataFrame) -> DataFrame:
    """Each collected fossil: ``resurrect`` if a new snapshot refers to it, else ``delete``."""
    used = new_refs.select("chunk_id").distinct().withColumn("used", F.lit(True))
    return fossils.select("chunk_id").distinct().join(used, "chunk_id", "left").select("chunk_id", F.when(F.col("used"), "resurrect").otherwise("delete").alias("action"))


def ghost_snapshots(deleted_revisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots that a collection has as deleted and that still exist: it must be discarded."""
    listed = deleted_revisions.select("id", F.explode("revisions").alias("revision")) if "revisions" in deleted_revisions.columns else deleted_revisions.select("id", "revision")
    return listed.join(snapshots.select("id", "revision"), ["id", "revision"], "left_semi")


def last_revisions(snapshots: DataFrame) -> DataFrame:
    """The last revision of each id, as a collection records it."""
    return snapshots.groupBy("id").agg(F.max("revision").alias("last_revision"))


def new_snapshots(snapshots: DataFrame, recorded: DataFrame, collected_at: int, consistent: bool = True, ignored: list[str] | None = None) -> DataFrame:
    """Per id in order, snapshots after the recorded revision, up to the first that ended after the collection."""
    limit = collected_at + (0 if consistent else SLACK)
    s = snapshots.filter(~F.col("id").isin(ignored)) if ignored else snapshots
    late = s.join(recorded, "id", "left").filter(F.col("revision") > F.coalesce("last_revision", F.lit(0))).withColumn("ends_after", F.col("end_time") > limit)
    before = F.max("ends_after").over(Window.partitionBy("id").orderBy("revision").rowsBetween(Window.unboundedPreceding, -1))
    return late.withColumn("seen", F.coalesce(before, F.lit(False))).filter(~F.col("seen")).drop("seen", "last_revision")


def deletable_by_host(snapshots: DataFrame, recorded: DataFrame, collected_at: int, now: int, consistent: bool = True, ignored: list[str] | None = None) -> DataFrame:
    """Per host: has it a new snapshot that ended after the collection, or been dormant?  All must, for fossils to go."""
    s = snapshots.filter(~F.col("id").isin(ignored)) if ignored else snapshots
    new = new_snapshots(snapshots, recorded, collected_at, consistent, ignored)
    progress = new.groupBy("id").agg(F.max("ends_after").alias("progress"), F.count("*").alias("n_new"))
    last = s.groupBy("id").agg(F.max(F.struct("revision", "end_time"))["end_time"].alias("last_end"))
    by_host = last.join(progress, "id", "left").groupBy(host_of(F.col("id")).alias("host")).agg(
        F.max(F.coalesce("progress", F.lit(False))).alias("progressed"), F.sum(F.coalesce("n_new", F.lit(0))).alias("n_new"), F.max("last_end").alias("last_end")
    )
    dormant = (F.col("last_end") > 0) & (F.col("last_end") < now - DORMANT_DAYS * DAY)
    return by_host.withColumn("safe", F.col("progressed") | dormant)


def is_deletable(snapshots: DataFrame, recorded: DataFrame, collected_at: int, now: int, consistent: bool = True, ignored: list[str] | None = None) -> DataFrame:
    """One row: ``deletable`` and, if so, the number of new snapshots."""
    hosts = deletable_by_host(snapshots, recorded, collected_at, now, consistent, ignored)
    return hosts.agg(F.min("safe").alias("deletable"), F.sum("n_new").alias("n")).select("deletable", F.when(F.col("deletable"), F.col("n")).otherwise(0).alias("n_new"))
