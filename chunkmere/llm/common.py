"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import cut, forget, in_order, shared_path

__all__ = ["attach_groups", "bound_batches", "cut", "forget", "in_order", "keep_only", "release_once", "release_worker", "shared_path", "table", "text_or_empty"]

#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 8 << 20
#: Rows that a broadcast side may have; larger sides are shuffled.
BROADCAST_ROWS = 200_000
#: A group is hot when it holds more than one row in so many; there can't be more such groups than this.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python more closely than Spark's default, where the session leaves that: rows may be very long texts."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key) == default:
        spark.conf.set(key, str(BATCH_BYTES))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def release_worker(keep: str = "") -> None:
    """Give back what a reused Python worker holds from other operators' tasks: free memory, and encoders' words but for ``keep``'s."""
    for module, kept in (("tokens", "encoder"), ("pieces", "piece_encoder")):
        if module != keep and (found := sys.modules.get(f"{__package__}.{module}")):
            getattr(found, kept).cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc: large arrays get pages of their own, which go back when they are freed
        libc.mallopt(-3, 4 << 20)
        libc.malloc_trim(0)


_task: list[int] = [-1]


def release_once(keep: str = "") -> None:
    """:func:`release_worker` for functions that are called for each group: at a task's first."""
    now = TaskContext.get()
    if now is not None and now.taskAttemptId() != _task[0]:
        _task[0] = now.taskAttemptId()
        release_worker(keep)


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with the one row that ``groups`` has for each ``key``; ``size`` is the group's row count.

    Groups with over 1/HOT_SHARE of all rows number fewer than HOT_SHARE: they are broadcast, and
    their rows aren't shuffled.  The others are joined by key, at most 1/HOT_SHARE of all rows each.
    Both inputs are read more than once and should be checkpoints or scans.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(1, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > limit)
    if hot.isEmpty():
        return rows.join(groups, key)
    heavy = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(groups.filter(F.col(size) <= limit), key))


def keep_only(docs: DataFrame, keys: list[str], dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``keys`` (null-safe) are in ``dropped``.

    ``dropped`` is broadcast only if it has at most BROADCAST_ROWS rows, else both sides are shuffled.
    """
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = dropped.select(*(F.col(k).alias(f"__drop_{k}") for k in keys))
    on = None
    for k in keys:
        c = docs[k].eqNullSafe(right[f"__drop_{k}"])
        on = c if on is None else on & c
    return docs.join(F.broadcast(right) if few else right, on, "left_anti")
