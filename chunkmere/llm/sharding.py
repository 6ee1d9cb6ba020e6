"""Operator 10: shards along a Hilbert curve over metadata dimensions.

Each document's size (by quantiles), language and source (by rank of the name) are quantised to
``BITS`` bits, its place on the Hilbert curve through that grid is its curve index, and documents are
ordered by it.  Runs of that order, cut
where the summed bytes reach each shard's share, are the shards; so a shard, and each stretch of slots
in one, covers a compact box of the grid, and files can be pruned by any of the dimensions
(:func:`write_shards`).

Equal texts are one group: they take the smallest index of their members and lie next to each other
in one shard.  Groups that alone weigh over ``1/HEAVY`` of a shard (there are fewer than ``HEAVY``
of them for each shard) are set apart first, the heaviest to the lightest shard, and the order of all
others is cut so that every shard is filled up to its share.  Only a group for which no shard has that
much of its share left is split by document, like any run.

Law ``bytes``: sizes differ by no more than the heaviest group that isn't set apart, or document.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach_groups, cut, in_order, text_or_empty

#: Bits of each dimension; groups of more than a shard's share divided by this are set apart.
BITS, HEAVY = 8, 512


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of grid cells, an int array of shape (rows, dimensions).

    The transform to transposed coordinates works bit by bit from the top: where a coordinate has
    the bit, the lower bits of the first are inverted, else they are exchanged with its own; a Gray
    code then orders the axes, and their bits interleave to the index.
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            has = (x[i] & q) != 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(has, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] ^ t) >> b & 1
    return out


def _curve(bounds: list[int], size: Column, *cells: Column) -> Column:
    held = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([np.searchsorted(held, a), b, c], axis=1)))

    return run(size, *cells)


def _name_cells(rows: DataFrame, col: str) -> DataFrame:
    """``col, cell_<col>``: names by their rank among all, spread over the cells; neighbours share one where there are more names than cells."""
    cells = 1 << BITS
    names = rows.select(col).distinct()
    few = [r[0] for r in names.limit(cells + 1).collect()]
    if len(few) <= cells:
        ranked = [(name, i * cells // len(few)) for i, name in enumerate(sorted(few))]
        return F.broadcast(rows.sparkSession.createDataFrame(ranked or [("", 0)], f"{col} string, cell_{col} long"))
    names = cut(names)
    n = names.count()
    out = in_order(names, [col], F.lit(1)).select(col, F.floor(F.col("before") * cells / F.lit(n)).alias(f"cell_{col}"))
    return F.broadcast(out) if n <= BROADCAST_ROWS else out


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``id, size, text_crc32, sha, curve``."""
    text = text_or_empty(text_col)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long").alias("size")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size, F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"), name(lang_col).alias("lang"), name(source_col).alias("source"))
    cells = 1 << BITS
    bounds = docs.select(size).stat.approxQuantile("size", [i / cells for i in range(1, cells)], 0.25 / cells)
    names = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"))
    for c in ("lang", "source"):
        rows = rows.join(_name_cells(names, c), c)
    return rows.select("id", "size", "text_crc32", "sha", _curve(sorted(map(int, bounds)), F.col("size"), F.col("cell_lang"), F.col("cell_source")).alias("curve"))


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, lang_col: str, source_col: str, heavy: int) -> DataFrame:
    """``id, size, text_crc32, sha, curve, shard`` of every document."""
    spark = docs.sparkSession
    rows = cut(_rows(docs, id_col, text_col, lang_col, source_col))
    groups = cut(rows.groupBy("sha").agg(F.min("curve").alias("curve"), F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("bytes")).first()[0]
    if total is None:
        return rows.withColumn("shard", F.lit(0))
    share = total / shards
    apart, split, loads = [], [], [(0, k) for k in range(shards)]
    for r in sorted(groups.filter(F.col("bytes") > share / heavy).select("sha", "bytes", "n").collect(), key=lambda r: (-r["bytes"], r["sha"])):
        load, k = loads[0]
        if load + r["bytes"] <= share or r["n"] == 1:
            heapq.heapreplace(loads, (load + r["bytes"], k))
            apart.append((r["sha"], k))
        else:
            split.append((r["sha"],))
    held = {k: load for load, k in loads}
    free = [max(0.0, share - held[k]) for k in range(shards)]
    rest = total - sum(held.values())
    ends = np.cumsum([x * rest / sum(free) if sum(free) else rest / shards for x in free])[:-1].tolist()
    apart = F.broadcast(spark.createDataFrame(apart or [(None, 0)], "sha binary, shard int"))  # fewer than HEAVY rows a shard
    split_shas = F.broadcast(spark.createDataFrame(split or [(None,)], "sha binary"))
    whole = groups.join(split_shas, "sha", "left_anti")
    run = whole.join(apart, "sha", "left_anti").select("sha", "curve", F.lit(None).cast("long").alias("id"), "bytes", F.lit(None).cast("long").alias("text_crc32"))
    if split:
        curves = F.broadcast(groups.join(split_shas, "sha").select("sha", F.col("curve").alias("group_curve")))
        run = run.unionByName(rows.join(curves, "sha").select("sha", F.col("group_curve").alias("curve"), "id", F.col("size").alias("bytes"), "text_crc32"))
    middle = F.col("before") + F.col("bytes") / 2
    run = in_order(run, ["curve", "sha", "id"], F.col("bytes"))
    run = cut(run.withColumn("shard", sum((F.when(middle >= F.lit(e), 1).otherwise(0) for e in ends), F.lit(0)).cast("int")).drop("before"))
    of_group = run.filter("text_crc32 is null").select("sha", "shard").unionByName(groups.join(apart, "sha").select("sha", "shard"))
    of_group = cut(of_group.join(groups.select("sha", F.col("curve").alias("group_curve"), "n"), "sha"))
    done = attach_groups(rows.drop("curve").join(split_shas, "sha", "left_anti"), of_group, "sha", "n").select("id", "size", "text_crc32", "sha", F.col("group_curve").alias("curve"), "shard")
    if split:
        done = done.unionByName(run.filter("text_crc32 is not null").select("id", F.col("bytes").alias("size"), "text_crc32", "sha", "curve", "shard"))
    return done


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", heavy: int = HEAVY
) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, law, shard, slot, grown_shard, curve``.

    A size is the text's bytes in UTF-8 (null: none) plus one.  Null metadata has a cell of its own;
    a null id is a row like any other and comes first among equal texts; repeated rows get slots of
    their own; an empty table gives no rows; other columns are ignored.
    """
    done = in_order(_placed(docs, shards, id_col, text_col, lang_col, source_col, heavy), ["curve", "sha", "id"], F.lit(1), ["shard"])
    return done.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def write_shards(
    docs: DataFrame, path: str, shards: int = 8, file_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", heavy: int = HEAVY
) -> None:
    """Write ``docs``, all columns and rows, as Parquet under ``path/shard=<k>``, in curve order, at most ``file_rows`` rows a file.

    Each file's statistics then bound a small range of sizes, languages and sources, by which readers
    skip files.  Rows of one id and text that a cut parts go to the first of their shards.
    """
    placed = _placed(docs, shards, id_col, text_col, lang_col, source_col, heavy)
    where = placed.groupBy(F.col("id").alias("__id"), F.col("sha").alias("__sha")).agg(F.min("shard").alias("shard"), F.min("curve").alias("__curve"))
    tagged = docs.drop("shard").withColumn("__key", F.unhex(F.sha2(text_or_empty(text_col), 256)))
    laid = tagged.join(where, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha"))).drop("__key", "__id")
    laid = laid.repartitionByRange("shard", "__curve", "__sha").sortWithinPartitions("shard", "__curve", "__sha", id_col).drop("__curve", "__sha")
    laid.write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)
