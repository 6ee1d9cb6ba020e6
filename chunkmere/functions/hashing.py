"""Hashes and ids of chunks and files."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The level from which hashes are BLAKE2b; below they are SHA-256.
FIRST_BLAKE_LEVEL = 100


def keyed_hash(key: bytes, data: bytes, level: int = FIRST_BLAKE_LEVEL) -> bytes:
    if level >= FIRST_BLAKE_LEVEL:
        return hashlib.blake2b(data, digest_size=32, key=key).digest()
    return hmac.new(key, data, hashlib.sha256).digest()


def file_hasher(level: int = FIRST_BLAKE_LEVEL):
    """What a file's bytes are fed to, window by window."""
    return hashlib.blake2b(digest_size=32) if level >= FIRST_BLAKE_LEVEL else hashlib.sha256()


def file_hash(data: bytes, level: int = FIRST_BLAKE_LEVEL) -> str:
    whole = file_hasher(level)
    whole.update(data)
    return whole.hexdigest()


def master_key(password: str, salt: bytes, iterations: int = 16384) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, 32)


def _over_bytes(f: Callable[[bytes], str]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(bytes(x)))

    return lambda c: run(c.cast("binary"))


def chunk_hash(content: Column, key: bytes, level: int = FIRST_BLAKE_LEVEL) -> Column:
    """Hex of the keyed hash of a chunk's content."""
    return _over_bytes(lambda b: keyed_hash(key, b, level).hex())(content)


def chunk_id(hash_hex: Column, id_key: bytes, level: int = FIRST_BLAKE_LEVEL) -> Column:
    """A chunk's public name: the keyed hash of its hash."""
    return _over_bytes(lambda b: keyed_hash(id_key, b, level).hex())(F.unhex(hash_hex))


def content_hash(content: Column, level: int = FIRST_BLAKE_LEVEL) -> Column:
    """Hex of a file's hash; SHA-256 needs no Python."""
    return _over_bytes(lambda b: file_hash(b, level))(content) if level >= FIRST_BLAKE_LEVEL else F.sha2(content, 256)
