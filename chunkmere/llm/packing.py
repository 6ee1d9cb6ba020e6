"""Operator 6: packing token sequences as a cutting-stock problem, by column generation.

A document's tokens are cut into pieces of the sequence length and a remainder.  Remainders are
classed by length, rounded up to ``QUANTUM`` tokens, and counted over all documents.  A linear
program chooses how often to use each pattern (how many pieces of which classes fill a sequence) so
that all pieces have a place in the fewest sequences; its columns are generated one by one, priced by
an unbounded-knapsack dynamic program over the duals.  The program's size depends on the number of
classes alone.  Rounded down, its patterns place nearly all pieces, and best-fit decreasing places
the few that are left.

Pieces are ranked within their class by a range sort, so that every piece finds its sequence and slot
from its rank and the pattern table; no task sees more than one sequence's pieces at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, cut, in_order, release_worker, text_or_empty
from .tokens import encoder, slices

LENGTH, QUANTUM = 2048, 8
#: Words that a worker keeps.
CACHED = 500_000
#: The program ends when its value is within this share, or within one sequence, of the dual bound.
GAP = 5e-4
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"


def price(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: (value, how many of each width).  ``duals[w]`` is the value of width ``w``; index 0 is unused."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = best[:c][::-1] + duals[1 : c + 1]  # width w leaves c - w
        w = int(value.argmax()) + 1
        best[c], pick[c] = (value[w - 1], w) if value[w - 1] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if pick[c]:
            pattern[pick[c]] += 1
            c -= int(pick[c])
        else:
            c -= 1
    return float(best[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination, without a threaded library in the driver."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for i in range(n):
        k = i + int(np.abs(both[i:, i]).argmax())
        both[[i, k]] = both[[k, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0.0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[i]
    return both[:, n:]


def _first_columns(wanted: np.ndarray, widths: np.ndarray, capacity: int) -> list[np.ndarray]:
    """A triangular basis: patterns filled with the widest pieces left, each used until one of its widths runs out."""
    left, out = wanted.copy(), []
    while (left > 0).any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        for i in np.flatnonzero(left > 0)[::-1]:
            pattern[widths[i]] = min(room // widths[i], max(1, int(left[i])))
            room -= pattern[widths[i]] * widths[i]
        used = pattern[widths]
        times = (left[used > 0] / used[used > 0]).min()
        before = left > 0
        left -= times * used
        left[left < 1e-7] = 0.0
        for k, i in enumerate(np.flatnonzero(before & (left == 0))):
            out.append(pattern if k == 0 else np.where(np.arange(capacity + 1) == widths[i], capacity // widths[i], 0))
    return out


def generate_columns(demand: np.ndarray, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, as fractions, to cover ``demand[w]`` pieces of each width ``w``; index 0 is unused."""
    capacity = len(demand) - 1
    widths = np.flatnonzero(demand[1:] > 0) + 1
    m = len(widths)
    if not m:
        return []
    wanted = demand[widths].astype(float)
    columns = _first_columns(wanted, widths, capacity)
    basis = np.stack([c[widths] for c in columns], axis=1).astype(float)
    inverse = _inverse(basis)
    for step in range(1, 8 * m + 100):
        used = np.maximum((inverse * wanted).sum(axis=1), 0.0)
        duals = np.zeros(capacity + 1)
        duals[widths] = np.maximum(inverse.sum(axis=0), 0.0)
        value, pattern = price(duals, capacity)
        total = used.sum()
        if value <= 1 + 1e-9 or total - total / value <= max(0.5, gap * total):
            break
        turn = (inverse * pattern[widths]).sum(axis=1)
        rises = turn > 1e-9
        if not rises.any():
            break
        out = int(np.where(rises, used / np.where(rises, turn, 1.0), np.inf).argmin())
        columns[out] = pattern
        basis[:, out] = pattern[widths]
        if step % 64 == 0:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / turn[out]
            inverse -= np.outer(turn, row)
            inverse[out] = row
    used = np.maximum((_inverse(basis) * wanted).sum(axis=1), 0.0)
    return list(zip(columns, used.tolist()))


def round_patterns(demand: np.ndarray, fractions: list[tuple[np.ndarray, float]]) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that place every piece: fractions rounded down, then best-fit decreasing for the rest."""
    capacity, left, out = len(demand) - 1, demand.astype(np.int64).copy(), []
    for pattern, x in sorted(fractions, key=lambda p: -p[1]):
        times = int(x + 1e-6)
        if times:
            out.append((pattern, times))
            left -= pattern * times
    left = np.maximum(left, 0)
    open_bins: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]  # by the room they have
    for w in range(capacity, 0, -1):
        for _ in range(int(left[w])):
            room = next((r for r in range(w, capacity + 1) if open_bins[r]), None)
            held = open_bins[room].pop() if room is not None else np.zeros(capacity + 1, np.int64)
            held[w] += 1
            open_bins[(capacity if room is None else room) - w].append(held)
    rest: dict[bytes, int] = {}
    for bins in open_bins:
        for b in bins:
            rest[b.tobytes()] = rest.get(b.tobytes(), 0) + 1
    return out + [(np.frombuffer(k, np.int64), n) for k, n in rest.items()]


@dataclass(frozen=True)
class Places:
    """Where pieces go by their rank among all, ordered by class: runs of ranks that share a pattern."""

    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray

    def find(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.first, rank, "right") - 1
        k = rank - self.first[i]
        return self.sequence[i] + k // self.each[i], self.slot[i] + k % self.each[i]


def plan(demand: np.ndarray, gap: float = GAP) -> Places:
    patterns = round_patterns(demand, generate_columns(demand, gap))
    starts = np.cumsum(demand) - demand
    taken = np.zeros(len(demand), np.int64)
    runs, sequence = [], 0
    for pattern, times in patterns:
        slot = 0
        for w in np.flatnonzero(pattern)[::-1].tolist():
            n = int(min(pattern[w] * times, demand[w] - taken[w]))
            if n > 0:
                runs.append((int(starts[w] + taken[w]), int(pattern[w]), sequence, slot))
                taken[w] += n
            slot += int(pattern[w])
        sequence += times
    if (taken != demand).any():
        raise AssertionError("pieces without a place")
    return Places(*(np.array(x, np.int64) for x in zip(*sorted(runs)))) if runs else Places(*(np.zeros(1, np.int64),) * 4)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's pieces (PIECES): whole texts (null: empty) encoded, ``end_id`` after them, cut at every ``length`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker(keep="tokens")
        made = encoder(tokenizer, CACHED)
        for b in batches:
            names, row = b.column(0).to_pylist(), 0
            for texts in slices(b.column(1), 2 << 20):
                ids, bounds = made.encode(texts)
                raw, bounds, out = memoryview(ids.astype("<u4").tobytes()), bounds.tolist(), []
                end = int(end_id).to_bytes(4, "little")
                for i in range(len(texts)):
                    a, z = bounds[i], bounds[i + 1]
                    n = z - a + 1
                    for s in range(0, n, length):
                        e = min(n, s + length)
                        crc = zlib.crc32(raw[4 * (a + s) : 4 * min(z, a + e)])
                        out.append((names[row], s, e - s, zlib.crc32(end, crc) if e == n else crc, n))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], [x.split()[0] for x in PIECES.split(", ")])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, quantum: int = QUANTUM, id_col: str = "doc_id", text_col: str = "text", gap: float = GAP
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to``.

    A sequence's pieces lie one after another from offset 0.  ``padded_to`` is what it is padded to:
    the sequence length, or its own if that is a power of two.  A null id is kept; repeated rows are
    documents of their own; an empty table gives no rows; other columns are ignored.
    """
    pieces = cut(cut_pieces(docs, tokenizer, end_id, length, id_col, text_col).withColumn("width", F.ceil(F.col("length") / quantum).cast("int")))
    demand = np.zeros(-(-length // quantum) + 1, np.int64)
    for r in pieces.groupBy("width").count().collect():  # one row a class
        demand[r["width"]] = r["count"]
    places = plan(demand, gap)

    @F.pandas_udf("sequence_id long, slot long")
    def place(rank: pd.Series) -> pd.DataFrame:
        s, k = places.find(rank.to_numpy())
        return pd.DataFrame({"sequence_id": s, "slot": k})

    ranked = in_order(pieces, ["width", "id", "start"], F.lit(1)).withColumn("at", place("before"))
    one = Window.partitionBy("sequence_id")
    before = one.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = ranked.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.slot")
    total = F.sum("length").over(one)
    power = F.bitwiseAND(total, total - 1) == 0 if hasattr(F, "bitwiseAND") else total.bitwiseAND(total - 1) == 0
    return out.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        total.alias("sequence_tokens"), F.when(power, total).otherwise(F.lit(length)).alias("padded_to"),
    )
