"""A repository of files as a Spark data source (S1, S2, S22, S26, P9): metadata only, a task for each top directory."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import MODE_DIR, MODE_LINK

SCHEMA = "path string, size long, time long, mode long, link string, uid int, gid int, attributes map<string,binary>, skip_reason string"
#: The engine's own folder in a repository.
OWN_FOLDER = ".chunkmere"


def _row(top: str, path: str) -> tuple:
    full = os.path.join(top, path)
    s = os.lstat(full)
    link, reason, mode = None, None, stat.S_IMODE(s.st_mode)
    if stat.S_ISLNK(s.st_mode):
        mode, link = mode | MODE_LINK, os.readlink(full)
    elif stat.S_ISDIR(s.st_mode):
        mode |= MODE_DIR
    elif not stat.S_ISREG(s.st_mode):
        reason = "not a regular file"
    attributes = {}
    if hasattr(os, "listxattr") and not link:
        try:
            attributes = {n.removeprefix("user."): os.getxattr(full, n) for n in os.listxattr(full)}
        except OSError:
            pass
    is_dir = bool(mode & MODE_DIR)
    return path + "/" * is_dir, 0 if is_dir or link else s.st_size, int(s.st_mtime), mode, link, s.st_uid, s.st_gid, attributes, reason


class _Reader(DataSourceReader):
    def __init__(self, top: str):
        self.top = top

    def partitions(self) -> list[InputPartition]:
        # A listing failure at the top is fatal.
        return [InputPartition(n) for n in sorted(os.listdir(self.top)) if n != OWN_FOLDER] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        yield (first := _row(self.top, partition.value))
        stack = [partition.value] if first[3] & MODE_DIR else []
        while stack:
            folder = stack.pop()
            try:
                names = sorted(os.listdir(os.path.join(self.top, folder)))
            except OSError as e:  # below the top it is noted
                yield f"{folder}/", 0, 0, MODE_DIR, None, None, None, {}, f"can't be listed: {e.strerror}"
                continue
            for n in names:
                yield (row := _row(self.top, f"{folder}/{n}"))
                if row[3] & MODE_DIR:
                    stack.append(f"{folder}/{n}")


class RepositorySource(DataSource):
    """``spark.read.format("repository").load(folder)``; executors must see the folder."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(os.path.abspath(self.options["path"]))


def read_repository(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").load(folder)
