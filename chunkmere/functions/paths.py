"""Paths, ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collation_key(path: Column) -> Column:
    """A sort key for the directory order: in each directory files, then directories, bytewise, then the contents of each.

    A path that ends with a slash is a directory.  The key has an element for each component:
    (not the last, a directory, its bytes); arrays of structs compare element by element.
    """
    is_dir = path.endswith("/")
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    n = F.size(parts)
    return F.transform(parts, lambda x, i: F.struct((i < n - 1).cast("int").alias("inner"), ((i < n - 1) | is_dir).cast("int").alias("dir"), x.cast("binary").alias("name")))


def parent(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]+/?$", 1)


def host_of(snapshot_id: Column) -> Column:
    """What follows the first ``@`` of a snapshot id, else the id."""
    return F.when(snapshot_id.contains("@"), F.regexp_extract(snapshot_id, r"@(.*)$", 1)).otherwise(snapshot_id)


def chunk_path(chunk_id: Column, level: int = 1) -> Column:
    """``chunks/`` and the id, split after each of the first ``level`` pairs of digits."""
    parts = [F.substring(chunk_id, 2 * i + 1, 2) for i in range(level)]
    return F.concat_ws("/", F.lit("chunks"), *parts, F.substr(chunk_id, F.lit(2 * level + 1)))


def chunk_of_path(path: Column) -> Column:
    """The chunk id of a stored object's path, fossil or not."""
    return F.regexp_replace(F.regexp_replace(path, r"^chunks/|\.fsl$|\.tmp$", ""), "/", "")


def object_state(name: Column) -> Column:
    """chunk, fossil, tmp or unknown, by suffix and the shape of the id."""
    bare = chunk_of_path(name)
    good = bare.rlike("^[0-9a-f]{64}$")
    return F.when(name.endswith(".tmp"), "tmp").when(name.endswith(".fsl") & good, "fossil").when(good, "chunk").otherwise("unknown")
