"""Running sums and neighbours in an order, at any size of a group.

A window would sort a whole group in one task.  Here rows are dealt by range of (group, order), each
part is scanned by itself, and what a part's first group takes over from the parts before it is worked
out from a few numbers a part.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a sorted table, at most; the driver holds a few numbers for each.
MOST_PARTS = 8192


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); one of our own only where it is unset and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chunkmere-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there (a reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*cuts: DataFrame) -> None:
    """Delete what :func:`cut` wrote for these frames.  Only once nothing is computed from them any more."""
    for df in cuts:
        sc = df.sparkSession.sparkContext
        rdd = df._jdf.queryExecution().logical().rdd()
        if rdd.getCheckpointFile().isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, by rows as they lie, the weight before them in their run of equal keys, the lagged value before them in it, and their number."""
    key, total, last, number = None, 0, None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        keys, weight, lagged = b.column("__key"), b.column("__weight").to_numpy(), b.column("__lag")
        fresh = np.ones(n, bool)
        fresh[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        goes_on = number > 0 and keys[0].as_py() == key
        fresh[0] = not goes_on
        before = np.cumsum(weight) - weight + (total if goes_on else 0)
        run = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        before = before - np.where(fresh[run], before[run], 0)
        shifted = pa.concat_arrays([pa.array([last if goes_on else None], pa.int64()), lagged.slice(0, n - 1)])
        shifted = pc.if_else(pa.array(fresh), pa.scalar(None, pa.int64()), shifted)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before, pa.int64()), shifted, pa.array(number + np.arange(n), pa.int64())], [*b.schema.names, "__before", "__previous", "__row"])
        key, total, last, number = keys[n - 1].as_py(), int(before[-1] + weight[-1]), lagged[n - 1].as_py(), number + n


def in_order(rows: DataFrame, by: list[str], weight: Column, group: list[str] | None = None, lag: str | None = None) -> DataFrame:
    """``rows`` with ``before``: the weight of the rows before theirs in the order ``by``, in their ``group`` if one is given.

    With ``lag``, a column of long values, also ``previous``: its value in the row before, null for a group's first.
    """
    spark = rows.sparkSession
    parts = min(MOST_PARTS, max(2, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = group or []
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    laid = rows.withColumn("__weight", weight.cast("long")).withColumn("__lag", F.col(lag).cast("long") if lag else F.lit(None).cast("long")).withColumn("__key", key)
    laid = laid.repartitionByRange(parts, *keys, *by).sortWithinPartitions(*keys, *by).withColumn("__part", F.spark_partition_id())
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    laid = cut(laid.mapInArrow(_scan, f"{types}, __before long, __previous long, __row long"))
    ends = laid.groupBy("__part").agg(
        F.min_by("__key", "__row").alias("first"), F.max_by("__key", "__row").alias("last"), F.min("__key").alias("low"), F.max("__key").alias("high"),
        F.max_by(F.col("__before") + F.col("__weight"), "__row").alias("tail"), F.max_by(F.struct("__lag"), "__row").alias("lag"),
    )
    held, key_now, total, last = [], None, 0, None
    for r in ends.orderBy("__part").collect():  # one row a part
        goes_on = r["first"] == key_now
        held.append((r["__part"], r["first"], total if goes_on else 0, last if goes_on else None))
        total = r["tail"] + (total if goes_on and r["low"] == r["high"] else 0)
        key_now, last = r["last"], r["lag"]["__lag"]
    starts = spark.createDataFrame(held or [(-1, "", 0, None)], "__part int, __first string, __start long, __old long")
    own = F.col("__key") == F.col("__first")
    out = laid.join(F.broadcast(starts), "__part").withColumn("before", F.col("__before") + F.when(own, F.col("__start")).otherwise(0))
    if lag:
        # A group's first row in a part has no value before it there: the row before lies in an earlier part.
        out = out.withColumn("previous", F.when(own & (F.col("__row") == 0), F.col("__old")).otherwise(F.col("__previous")))
    return out.drop(*(c for c in out.columns if c.startswith("__") and c not in rows.columns))
