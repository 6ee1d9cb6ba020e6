"""Operator 1: exact dedup by a tree-merge of sorted digest runs.

Every partition sorts its texts' SHA-256 digests into a run with, for each digest, the best
identifier, the number of rows, and the text's byte length.  Runs are then exchanged in binomial
rounds over ``2**m`` nodes: in round ``j`` a node sends the part of its run whose digests have
another ``j``-th group of bits to the node that differs from it in just these bits, and merges the
runs that reach it, ``2**bits`` ways at once.  After the last round each node holds the digests
whose low bits are its number.  Every merge keeps one entry a digest, so a text that holds a third
of all rows costs one entry a node and round, and no task sees more than its share of digests.
At each level equal digests must agree on the byte length (else the run fails: a corrupt run or a
digest collision).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, cut, keep_only, release_worker, text_or_empty

#: Runs that a merge takes at once: 2**BITS.
BITS = 4
MOST_NODES = 1 << 16
RUN = "target int, digests binary, entries binary"
GROUP = "digest binary, keep_id long, group_size long, ties long"


def _pack(target: int, run: list[tuple]) -> tuple[int, bytes, bytes]:
    """entries: (missing id, id, rows, ties, byte length) for each digest."""
    return target, b"".join(x[0] for x in run), np.array([x[1:] for x in run], dtype="<i8").reshape(len(run), 5).tobytes()


def _unpack(digests: bytes, entries: bytes) -> list[tuple]:
    return [(digests[32 * i : 32 * i + 32], *x) for i, x in enumerate(np.frombuffer(entries, "<i8").reshape(-1, 5).tolist())]


def merge_runs(runs: list[list[tuple]], sign: int) -> Iterator[tuple]:
    """Multiway merge of sorted runs into one with an entry a digest: the best id, summed rows and ties."""
    ordered = heapq.merge(*runs, key=lambda x: (x[0], x[1], sign * x[2]))
    for digest, same in groupby(ordered, key=lambda x: x[0]):
        _, missing, best, rows, ties, length = next(same)
        for _, m, i, r, t, n in same:
            if n != length:
                raise ValueError(f"digest {digest.hex()} stands for texts of {length} and {n} bytes")
            rows += r
            if (m, i) == (missing, best):
                ties += t
        yield digest, missing, best, rows, ties, length


def _route(run: Iterator[tuple], node: int, level: int, nodes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The parts of a run by the node that takes them in round ``level``."""
    mask = ((1 << BITS) - 1) << (BITS * level) & (nodes - 1)
    parts: dict[int, list[tuple]] = {}
    for x in run:
        parts.setdefault((node & ~mask) | (int.from_bytes(x[0][:4], "big") & mask), []).append(x)
    for target in sorted(parts):
        yield _pack(target, parts[target])


def _runs_table(parts: list[tuple[int, bytes, bytes]]) -> pa.Table:
    t, d, e = zip(*parts) if parts else ((), (), ())
    return pa.table({"target": pa.array(t, pa.int32()), "digests": pa.array(d, pa.binary()), "entries": pa.array(e, pa.binary())})


def _first_runs(nodes: int, sign: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        best: dict[bytes, tuple] = {}
        for b in batches:
            for digest, i, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                new = (digest, int(i is None), i or 0, 1, 1, n)
                best[digest] = next(merge_runs([[best[digest]], [new]], sign)) if digest in best else new
        node = TaskContext.get().partitionId() % nodes
        yield from _runs_table(list(_route(iter(sorted(best.values())), node, 0, nodes))).to_batches()

    return run


def _merge_round(level: int, nodes: int, sign: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        runs = [_unpack(d, e) for d, e in zip(group["digests"].to_pylist(), group["entries"].to_pylist())]
        return _runs_table(list(_route(merge_runs(runs, sign), key[0].as_py(), level, nodes)))

    return run


def _last_round(sign: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        runs = [_unpack(d, e) for d, e in zip(group["digests"].to_pylist(), group["entries"].to_pylist())]
        out = list(merge_runs(runs, sign))
        return pa.table(
            {
                "digest": pa.array([x[0] for x in out], pa.binary()),
                "keep_id": pa.array([None if x[1] else x[2] for x in out], pa.int64()),
                "group_size": pa.array([x[3] for x in out], pa.int64()),
                "ties": pa.array([x[4] for x in out], pa.int64()),
            }
        )

    return run


def merge_tree(digests: DataFrame, keep: str = "min", nodes: int | None = None) -> DataFrame:
    """Groups ``(digest, keep_id, group_size, ties)`` of rows ``(digest binary, id long, n_bytes long)``."""
    sign = {"min": 1, "max": -1}[keep]
    if nodes is None:
        parts = digests.rdd.getNumPartitions()
        nodes = 1 << min(MOST_NODES, max(2, parts) - 1).bit_length()
    rounds = max(1, -(-(nodes - 1).bit_length() // BITS))
    runs = digests.select("digest", "id", "n_bytes").mapInArrow(_first_runs(nodes, sign), RUN)
    for level in range(1, rounds):
        runs = runs.groupBy("target").applyInArrow(_merge_round(level, nodes, sign), RUN)
    return runs.groupBy("target").applyInArrow(_last_round(sign), GROUP)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", nodes: int | None = None) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, ties, kept, text_sha256``.

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the smallest
    (``keep="min"``) or largest id stays.  A null id loses to any other; if all are null, keep_id is
    null and these rows count as kept.  Repeated rows (same id and text) are all marked kept, ``ties``
    of them; :func:`drop_copies` leaves one.  An empty table gives an empty result; other columns of
    ``docs``, whatever their names, are ignored.
    """
    text = text_or_empty(text_col)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    groups = cut(merge_tree(rows, keep, nodes))
    joined = attach_groups(rows.select("id", "digest"), groups, "digest", "group_size")
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "ties", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    decided = cut(exact_dedup(docs, id_col, text_col, keep).select(id_col, "kept", "ties", "text_sha256"))
    out = keep_only(docs, [id_col], decided.filter(~F.col("kept")).select(id_col))
    if decided.filter(F.col("kept") & (F.col("ties") > 1)).isEmpty() and decided.groupBy(id_col).count().filter("count > 1").isEmpty():
        return out
    # An id that stands for several texts, or a repeated row: decide by id and text together.
    tagged = docs.withColumn("__sha", F.sha2(text_or_empty(text_col), 256))
    lost = decided.filter(~F.col("kept")).select(id_col, F.col("text_sha256").alias("__sha")).distinct()
    return keep_only(tagged, [id_col, "__sha"], lost).dropDuplicates([id_col, "__sha"]).drop("__sha")
