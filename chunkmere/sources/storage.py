"""Storage URLs (B1-B18): which Hadoop file system serves each, and what the storage can do."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Kind:
    """What a storage can do: rename objects, show writes at once, list quickly; and the levels of its chunk folders."""

    scheme: str | None
    moves: bool = True
    consistent: bool = True
    lists_fast: bool = False
    level: int = 0


#: By URL scheme.  ``scheme`` is Hadoop's; None: Spark has no connector for it, mount it or add one.
KINDS = {
    "file": Kind("file", level=2), "flat": Kind("file", level=0), "samba": Kind("file", level=2), "smb": Kind("file", level=2),
    "sftp": Kind("sftp", level=2), "sftpc": Kind("sftp", level=2),
    "s3": Kind("s3a", consistent=False, lists_fast=True), "minio": Kind("s3a", consistent=False, lists_fast=True), "minios": Kind("s3a", consistent=False, lists_fast=True),
    "s3c": Kind("s3a", consistent=False, lists_fast=True), "wasabi": Kind("s3a", lists_fast=True), "b2": Kind("s3a", lists_fast=True), "b2-custom": Kind("s3a", lists_fast=True),
    "storj": Kind("s3a", consistent=False, lists_fast=True, level=2), "azure": Kind("abfss", lists_fast=True), "gcs": Kind("gs", lists_fast=True),
    "dropbox": Kind(None, consistent=False, level=1), "acd": Kind(None, lists_fast=True), "gcd": Kind(None, consistent=False, lists_fast=True),
    "one": Kind(None, consistent=False, lists_fast=True), "odb": Kind(None, consistent=False, lists_fast=True), "hubic": Kind(None, consistent=False, lists_fast=True),
    "swift": Kind(None, consistent=False, lists_fast=True, level=1), "webdav": Kind(None, consistent=False), "webdav-http": Kind(None, consistent=False), "fabric": Kind(None, consistent=False),
}


def resolve(url: str) -> tuple[Kind, str]:
    """The kind of a storage URL and the path that Spark reads and writes."""
    m = re.match(r"^([a-z][a-z0-9-]*)://(.*)$", url)
    if not m:
        return KINDS["file"], f"file://{url}" if url.startswith("/") else url
    kind = KINDS.get(m[1])
    if kind is None:
        if m[1] in ("hdfs", "viewfs", "s3a", "gs", "abfss"):
            return Kind(m[1]), url
        raise ValueError(f"unknown storage {url!r}")
    if kind.scheme is None:
        raise NotImplementedError(f"Spark has no connector for {m[1]}; mount it and use its path")
    return kind, f"{kind.scheme}://{m[2]}"
