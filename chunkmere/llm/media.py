"""Operator 5: media columns: byte payloads as 8-bit WAV, with spectral-peak fingerprints.

A payload is stored as one unsigned 8-bit sample a byte in a RIFF/WAVE file, written and read back
with the ``wave`` module; the WAV column is written to a Parquet table in the shared folder and read
back from there.  Features come from a short-time Fourier transform of the samples that
were read: in each frame the strongest local maxima of the magnitude spectrum are peaks, each peak
is paired with peaks of the next frames, and a pair's two bins and distance in time form a code.
Fingerprints are arrays of longs, the anchor's frame in the upper and the code in the lower half.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release_worker, shared_path, text_or_empty

#: Payloads are padded to a multiple of this; samples a second.
UNIT, PAD, RATE = 576, 255, 8000
#: Samples of a frame and from one frame to the next; peaks of a frame; frames ahead in which an anchor's partners lie.
FRAME, HOP, PEAKS, AHEAD = 576, 288, 3, 2
#: Frames transformed at once; rows of a batch that goes back to the JVM.
CHUNK, ROWS = 4096, 256
MEDIA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, "
    "n_frames long, n_peaks long, fingerprint array<bigint>, feature string"
)


def to_payload(data: bytes) -> bytes:
    return data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not mono samples of 8 bits")
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, found) of each frame's strongest local maxima, both of shape (frames, PEAKS); bins ascend by strength's rank."""
    x = samples.astype(np.float32) - 128.0
    frames = 1 + max(0, len(x) - FRAME) // HOP
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    bins, found = np.empty((frames, PEAKS), np.int64), np.empty((frames, PEAKS), bool)
    for i in range(0, frames, CHUNK):
        mag = np.abs(np.fft.rfft(views[i : i + CHUNK] * _WINDOW, axis=1)).astype(np.float32)
        inner = mag[:, 1:-1]
        strong = np.where((inner > mag[:, :-2]) & (inner >= mag[:, 2:]) & (inner > 1.0), inner, 0.0)
        top = np.argpartition(-strong, PEAKS, axis=1)[:, :PEAKS]
        value = np.take_along_axis(strong, top, 1)
        order = np.lexsort((top, -value), axis=1)
        bins[i : i + CHUNK] = np.take_along_axis(top, order, 1) + 1
        found[i : i + CHUNK] = np.take_along_axis(value, order, 1) > 0
    return bins, found


def fingerprint(bins: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Time-coded pair codes in order: frame << 32 | first bin << 16 | second bin << 4 | frames between."""
    out, frames = [], len(bins)
    for d in range(1, AHEAD + 1):
        if frames <= d:
            break
        both = found[:-d, :, None] & found[d:, None, :]
        t, a, b = np.nonzero(both)
        out.append(t << 32 | bins[:-d][t, a] << 16 | bins[d:][t, b] << 4 | d)
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def describe(media: bytes) -> tuple:
    """What a stored WAV gives: the columns of MEDIA from ``payload_bytes`` on."""
    payload = from_wav(media)
    bins, found = peaks(np.frombuffer(payload, np.uint8))
    codes = fingerprint(bins, found)
    digest = hashlib.blake2b(codes.astype("<i8").tobytes(), digest_size=8).hexdigest()
    loudest = np.bincount(bins[found], minlength=1).argmax()
    feature = f"wav8;frames={len(bins)};peaks={int(found.sum())};pairs={len(codes)};top_bin={loudest};codes={digest}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), len(bins), int(found.sum()), codes, feature


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: each row's whole text in UTF-8, padded, as a WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                data = [x.as_buffer().to_pybytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, data), pa.int64()), pa.array([to_wav(to_payload(x)) for x in data], pa.binary())], ["id", "n_bytes", "media"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(stored: DataFrame, id_col: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """``id_col`` and the columns of MEDIA for rows ``(id_col, n_bytes, media)``; without ``keep_media`` the WAV isn't passed on."""
    schema = [x.split() for x in MEDIA.split(", ") if keep_media or x != "media binary"]
    types = {"fingerprint": pa.list_(pa.int64()), **dict.fromkeys(("payload_sha256", "media_sha256", "feature"), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        names = [n for n, _ in schema]
        made = [n for n in names if n not in ("n_bytes", "media")]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                rows = [describe(x.as_buffer().to_pybytes()) for x in part.column(2)]
                own = {n: pa.array([r[i] for r in rows], types.get(n, pa.int64())) for i, n in enumerate(made)}
                own |= {"n_bytes": part.column(1), "media": part.column(2)}
                yield pa.RecordBatch.from_arrays([part.column(0), *(own[n] for n in names)], ["id", *names])

    bound_batches(stored.sparkSession)
    out = ", ".join(f"{n} {t}" for n, t in schema)
    return stored.select(F.col(id_col).cast("long").alias("id"), "n_bytes", "media").mapInArrow(run, f"id long, {out}").withColumnRenamed("id", id_col)


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of :func:`to_media` to the Parquet table at ``path``."""
    to_media(docs, id_col, text_col).write.option("compression", "zstd").parquet(path)


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store the rows' media in the shared folder, read the table back, and give what :func:`media_features` finds in it.

    Null and empty texts give the payload of one unit of padding.  Equal texts give equal values and
    repeated rows repeat; a null id stays null; an empty table stays empty; other columns are ignored.
    """
    path = shared_path(docs.sparkSession, "media")
    store_media(docs, path, id_col, text_col)
    return media_features(docs.sparkSession.read.schema(f"`{id_col}` long, n_bytes long, media binary").parquet(path), id_col, keep_media)
