"""Word-shingle sets of whole texts as sorted 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
_RNG = np.random.default_rng(0x5A17)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_OTHER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that are hashed at once (a longer word is hashed alone), and powers that a worker keeps.
RUN_BYTES, KEPT_POWERS = 1 << 20, 1 << 21
_powers: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers of an odd base from 0 to n modulo 2**64."""
    held = _powers.get(base, np.ones(1, np.uint64))
    while len(held) <= n:
        held = np.concatenate([held, held * held[-1] * base])
    if len(held) <= KEPT_POWERS:
        _powers[base] = held
    return held


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """Hashes of the words from ``start`` to ``end`` by sums over runs of them; ``values`` are those of the bytes."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        first = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, first + RUN_BYTES, "right")))
        last = int(end[to - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(values[data[first:last]] * powers(_BASE, last - first)[: last - first], out=sums[1:])
        s, e = start[at:to] - first, end[at:to] - first
        out[at:to] = mix((sums[e] - sums[s]) * powers(_INVERSE, last - first)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_digests(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    start, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    with np.errstate(over="ignore"):
        return _word_hashes(data, start, end), _word_hashes(data, start, end, _OTHER)


def shingle_sets(texts: pa.StringArray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's distinct shingles, ascending.

    A-Z are lower-cased; words are runs of anything but space and the bytes 9 to 13.  A text with
    fewer words has its whole sequence as its one shingle; one without words, or null, has none.
    """
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    total = int(bounds[-1])
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8, total, int(offsets[0]))]
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[:-1][sizes > 0]
    begins[cuts] = inside[cuts]  # a word ends with its text
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        word = _word_hashes(data, start, end)
        first = np.searchsorted(start, bounds)  # each text's words
        counts = np.diff(first)
        n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
        out_bounds = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first[:-1] - out_bounds[:-1], n) + np.arange(int(out_bounds[-1]))
        padded = np.concatenate([word, np.zeros(words, np.uint64)])
        gram = np.zeros(len(at), np.uint64)
        held = np.repeat(np.minimum(counts, words), n)
        for j in range(words):
            part = padded[at + j] * _PLACE[j]
            gram += np.where(held > j, part, np.uint64(0)) if (held <= j).any() else part
        gram = mix(gram + held.astype(np.uint64) * _BASE)
    for a, z in zip(out_bounds[:-1].tolist(), out_bounds[1:].tolist()):
        if z - a > 1:
            gram[a:z].sort()
    fresh = np.ones(len(gram), bool)
    fresh[1:] = gram[1:] != gram[:-1]
    fresh[out_bounds[:-1][n > 0]] = True
    return gram[fresh], np.concatenate([[0], np.cumsum(fresh)])[out_bounds]


def digests(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    with np.errstate(over="ignore"):
        a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes * _PLACE[60]))])
        b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _PLACE[61]))])
        n = np.diff(bounds).astype(np.uint64)
        return mix(a[bounds[1:]] - a[bounds[:-1]] + n).view(np.int64), mix(b[bounds[1:]] - b[bounds[:-1]] + n).view(np.int64)


def batches_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, hashes, bounds) for runs of rows ``(id, text)`` of about ``most`` bytes of text, at most 60,000 rows."""
    from .tokens import slices

    ids: list = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0
    for b in batches:
        names, row = b.column(0).to_pylist(), 0
        for texts in slices(b.column(1), 1 << 20):
            for at in range(0, len(texts), 10_000):
                some = texts.slice(at, 10_000)
                hashes, bounds = shingle_sets(some)
                ids += names[row : row + len(some)]
                row += len(some)
                parts.append(hashes)
                counts.append(np.diff(bounds))
                held += int(pc.sum(pc.binary_length(some)).as_py() or 0)
                if held >= most or len(ids) > 50_000:
                    yield ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
                    ids, parts, counts, held = [], [], [], 0
    if ids:
        yield ids, np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
