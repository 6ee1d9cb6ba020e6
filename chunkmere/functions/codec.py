"""Chunk codecs (F4-F6, F8): compression, padding and AES-GCM, Reed-Solomon shards."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import keyed_hash

#: The marks of compressed chunks, the levels of each codec, the padding's unit.
LZ4_MARK, ZSTD_MARK, ERASURE_MARK = b"LZ4 ", b"ZSTD", b"chunkRS\x01"
LZ4_LEVEL, ZSTD_LEVELS = 100, {200: 1, 201: 3, 202: 7, 203: 11}
PADDING = 256


def compress(data: bytes, level: int = LZ4_LEVEL) -> bytes:
    if level == LZ4_LEVEL:
        return LZ4_MARK + struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)
    if level in ZSTD_LEVELS:
        return ZSTD_MARK + zstandard.ZstdCompressor(level=ZSTD_LEVELS[level]).compress(data)
    if -1 <= level <= 9:
        return zlib.compress(data, level)
    raise ValueError(f"unknown compression level {level}")


def decompress(data: bytes) -> bytes:
    if data[:4] == LZ4_MARK:
        n = struct.unpack_from("<I", data, 4)[0]
        return pa.Codec("lz4_raw").decompress(data[8:], n, asbytes=True) if n else b""
    if data[:4] == ZSTD_MARK:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data[4:])
    return zlib.decompress(data)


def pad(data: bytes) -> bytes:
    """Fill up to a multiple of PADDING; each filling byte is how many there are, modulo 256."""
    n = PADDING - len(data) % PADDING
    return data + bytes([n % 256]) * n


def unpad(data: bytes) -> bytes:
    n = (data[-1] or PADDING) if data else 0
    if not data or n > len(data) or data[-n:] != bytes([n % 256]) * n:
        raise ValueError("wrong padding")
    return data[:-n]


# ---------------------------------------------------------------- GF(256)

_EXP = np.zeros(512, np.uint8)
_LOG = np.zeros(256, np.int32)
_x = 1
for _i in range(255):
    _EXP[_i] = _EXP[_i + 255] = _x
    _LOG[_x] = _i
    _x = _x << 1 ^ (0x11D if _x & 0x80 else 0)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == 0) | (b == 0), 0, _EXP[_LOG[a] + _LOG[b]]).astype(np.uint8)


#: Row c: every byte times c.
_BY = _times(np.arange(256, dtype=np.uint8)[:, None], np.arange(256, dtype=np.uint8)[None, :])


def _product(m: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), rows.shape[1]), np.uint8)
    for i, k in zip(*np.nonzero(m)):
        out[i] ^= rows[k] if m[i, k] == 1 else _BY[m[i, k]][rows[k]]
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    both = np.concatenate([m, np.eye(n, dtype=np.uint8)], axis=1)
    for i in range(n):
        k = i + int(np.flatnonzero(both[i:, i])[0])
        both[[i, k]] = both[[k, i]]
        both[i] = _times(both[i], _EXP[255 - _LOG[both[i, i]]])
        for j in range(n):
            if j != i and both[j, i]:
                both[j] ^= _times(both[i], both[j, i])
    return both[:, n:]


def _matrix(data: int, parity: int) -> np.ndarray:
    """Identity rows, then a Cauchy matrix: any ``data`` rows can be inverted."""
    x, y = np.arange(data, data + parity), np.arange(data)
    return np.concatenate([np.eye(data, dtype=np.uint8), _EXP[255 - _LOG[x[:, None] ^ y]].astype(np.uint8)])


def _header(size: int, data: int, parity: int) -> bytes:
    body = struct.pack("<QHH", size, data, parity)
    return body + bytes([np.bitwise_xor.reduce(np.frombuffer(body[0::2], np.uint8)), np.bitwise_xor.reduce(np.frombuffer(body[1::2], np.uint8))])


def erasure_encode(content: bytes, data: int, parity: int) -> bytes:
    """Mark, header, a hash of each shard, the shards, header again."""
    size = max(1, -(-len(content) // data))
    rows = np.frombuffer(content.ljust(size * data, b"\0"), np.uint8).reshape(data, size)
    shards = _product(_matrix(data, parity), rows)
    head = _header(len(content), data, parity)
    return ERASURE_MARK + head + b"".join(hashlib.blake2s(s.tobytes()).digest() for s in shards) + shards.tobytes() + head


def erasure_decode(stored: bytes) -> bytes:
    """The content, recovered if ``data`` shards or more are intact; the shard size is the header's."""
    heads = [stored[len(ERASURE_MARK) : len(ERASURE_MARK) + 14], stored[-14:]]
    for head in heads:
        if len(head) == 14:
            size, data, parity = struct.unpack("<QHH", head[:12])
            if _header(size, data, parity) == head and data:
                break
    else:
        raise ValueError("both headers are damaged")
    if stored[: len(ERASURE_MARK)] != ERASURE_MARK and len(heads[0]) != 14:
        raise ValueError("not erasure coded")
    length, n = max(1, -(-size // data)), data + parity
    at = len(ERASURE_MARK) + 14
    shards = np.frombuffer(stored[at + 32 * n : at + 32 * n + length * n], np.uint8).reshape(n, length)
    good = [i for i in range(n) if hashlib.blake2s(shards[i].tobytes()).digest() == stored[at + 32 * i : at + 32 * i + 32]]
    if len(good) < data:
        raise ValueError(f"{len(good)} of {data} shards needed are intact")
    if good[:data] != list(range(data)):
        return _product(_inverse(_matrix(data, parity)[good[:data]]), shards[good[:data]]).tobytes()[:size]
    return shards[:data].tobytes()[:size]


# ---------------------------------------------------------------- columns


def _bytes_udf(f, strict: bool = True):
    """``f`` over a column of bytes; unless ``strict``, what it refuses becomes null."""

    def one(x):
        if x is None:
            return None
        try:
            return f(bytes(x))
        except Exception:  # whatever damaged bytes raise
            if strict:
                raise
            return None

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run


def encode_chunk(content: Column, level: int = LZ4_LEVEL, key: Column | None = None, shards: tuple[int, int] | None = None) -> Column:
    """Compress; with a 32-byte key pad and encrypt by AES-256-GCM in the JVM; then add parity shards."""
    sealed = key is not None
    out = _bytes_udf(lambda b: pad(compress(b, level)) if sealed else compress(b, level))(content.cast("binary"))
    if sealed:
        out = F.aes_encrypt(out, key, F.lit("GCM"))
    return _bytes_udf(lambda b: erasure_encode(b, *shards))(out) if shards else out


def decode_chunk(stored: Column, key: Column | None = None, erasure: bool = False, strict: bool = True) -> Column:
    """The content again; unless ``strict``, null for a damaged chunk or a wrong key."""
    sealed = key is not None
    out = _bytes_udf(erasure_decode, strict)(stored) if erasure else stored
    if sealed:
        out = (F.aes_decrypt if strict else F.try_aes_decrypt)(out, key, F.lit("GCM"))
    return _bytes_udf(lambda b: decompress(unpad(b) if sealed else b), strict)(out)


def derived_key(name: Column, secret: bytes) -> Column:
    """The key of one chunk, from its name and the storage's secret."""
    return _bytes_udf(lambda b: keyed_hash(b[:64], secret))(name.cast("binary"))
