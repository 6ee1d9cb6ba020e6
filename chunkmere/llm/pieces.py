"""Operator 3: SentencePiece encoding and decoding by a batched Viterbi in numpy.

Texts are cut into words before every run of spaces (no piece goes across such a place; a vocabulary
with one that does is refused).  Distinct words of equal length form a matrix of bytes and advance
together: at each position the hashes of all substrings that end there, from prefix sums, probe the
sorted hashes of the pieces, and each word's best candidate becomes its backpointer.

The best is that of the largest summed score: a unigram vocabulary's ids.  For a BPE vocabulary the
library's ids are another path through the same candidates: a token may follow another only if merging
their joined text gives just these two, and exactly one token that ends a prefix may follow the one
before it.  Whether a token may follow another is worked out once for each pair that occurs, and kept.
With ``both`` an encoder gives that path and the one of the largest score from one run.

Words longer than ``LONG_BYTES`` (texts without spaces) are scanned one by one: the same probes, for all
positions of a window at once and each length of a piece, then one pass over the candidates.

Characters without a piece become the pieces of their bytes.  Decoding gathers the pieces' bytes.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, release_worker, text_or_empty
from .shingles import _BASE, _BYTE, _INVERSE, mix, powers
from .tokens import WordEncoder, ragged, slices

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Longer words are scanned alone, so many bytes at a time; pairs of tokens that a worker keeps.
LONG_BYTES, WINDOW_BYTES, KEPT_PAIRS = 192, 1 << 19, 1 << 21
#: Marks an id of the path of the largest score where both paths go together.
BEST = np.uint32(1 << 31)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7)
            n = varint() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model: int
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A SentencePiece model file without a normalisation table, with byte pieces, that keeps all spaces."""
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        pieces, scores, kinds = [], [], []
        for k, v in top:
            if k == 1:
                own = dict(_fields(v))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
        trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
        norm = dict(_fields(next((v for k, v in top if k == 3), b"")))
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or BYTE not in kinds:
            raise ValueError("only vocabularies with byte pieces and without normalisation are supported")
        return cls(pieces, np.array(scores), np.array(kinds), trainer.get(3, UNIGRAM), bool(norm.get(3, 1)))


class PieceEncoder(WordEncoder):
    """Encodes and decodes with a vocabulary."""

    odd = "^ |  "
    first_spaced = True

    def __init__(self, path: str, both: bool = False):
        super().__init__()
        v = self.vocabulary = Vocabulary.load(path)
        self.both = both
        if not v.dummy_prefix:
            raise ValueError("only vocabularies with a dummy prefix are supported")
        self.text = [p.replace(SPACE, " ") for p in v.pieces]
        usable = np.isin(v.kinds, (NORMAL, USER, UNUSED))
        if any(re.search("[^ ] ", self.text[i]) for i in np.flatnonzero(usable)):
            raise ValueError("a piece goes across a place where texts are cut")
        raw = [t.encode() for t in self.text]
        self.longest = max(len(raw[i]) for i in np.flatnonzero(usable))
        ids = np.flatnonzero(usable)
        keys = np.concatenate([self._hashes(np.frombuffer(raw[i], np.uint8)[None, :], 0, len(raw[i])) for i in ids])
        by = np.argsort(keys)
        self.keys, self.key_ids = keys[by], ids[by]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.possible = np.zeros(1 << 20, bool)  # by the upper bits of a hash: whether a piece has them
        self.possible[self.keys >> np.uint64(44)] = True
        self.rank = {self.text[i]: -float(v.scores[i]) for i in ids}
        self.byte_ids = np.zeros(256, np.uint32)
        self.bytes_of: list[bytes] = [b"" if k in (CONTROL, UNKNOWN) else r for k, r in zip(v.kinds, raw)]
        for i in np.flatnonzero(v.kinds == BYTE):
            self.byte_ids[int(v.pieces[i][1:-1], 16)] = i
            self.bytes_of[i] = bytes([int(v.pieces[i][1:-1], 16)])
        self.decode_pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.decode_ends = np.cumsum([len(x) for x in self.bytes_of])
        self.lowest = float(v.scores[ids].min()) - UNKNOWN_PENALTY
        self.pairs, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
        self.new_pairs: dict[int, bool] = {}

    # ------------------------------------------------------------ lookups

    @staticmethod
    def _hashes(data: np.ndarray, start: int, end: int) -> np.ndarray:
        """Of the columns from start to end of each row."""
        with np.errstate(over="ignore"):
            part = _BYTE[data[:, start:end]] * powers(_BASE, end)[: end - start]
            return mix(part.sum(axis=1, dtype=np.uint64) + np.uint64(end - start))

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Pieces' ids by hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.key_ids[at], -1)

    def _merges_apart(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces leaves these two."""
        left = self.text[a]
        parts = list(left + self.text[b])
        border = len(left)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return len(parts) == 2
            begin = sum(map(len, parts[:at]))
            if begin < border < begin + len(parts[at]) + len(parts[at + 1]):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _known(self, key: int) -> bool:
        """Whether the pair's second token may follow the first."""
        ok = self.new_pairs.get(key)
        if ok is None:
            at = int(np.searchsorted(self.pairs, key))
            ok = bool(self.pair_ok[at]) if at < len(self.pairs) and self.pairs[at] == key else self._merges_apart(*divmod(key, len(self.text)))
            self.new_pairs[key] = ok
        return ok

    def _keep_pairs(self) -> None:
        """Sort new pairs into the kept ones; beyond KEPT_PAIRS all are forgotten."""
        if len(self.pairs) + len(self.new_pairs) > KEPT_PAIRS:
            self.pairs, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
        else:
            keys = np.concatenate([self.pairs, np.fromiter(self.new_pairs, np.int64, len(self.new_pairs))])
            ok = np.concatenate([self.pair_ok, np.fromiter(self.new_pairs.values(), bool, len(self.new_pairs))])
            self.pairs, at = np.unique(keys, return_index=True)
            self.pair_ok = ok[at]
        self.new_pairs = {}

    def _may_follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys = before.astype(np.int64) * len(self.text) + token
        if not len(self.pairs):
            return self._fresh(keys)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        ok = self.pair_ok[at]
        new = self.pairs[at] != keys
        if new.any():
            ok[new] = self._fresh(keys[new])
        return ok

    def _fresh(self, keys: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(keys, return_inverse=True)
        ok = np.fromiter(map(self._known, distinct.tolist()), bool, len(distinct))
        if len(self.new_pairs) > 4096 + len(self.pairs) // 4:
            self._keep_pairs()
        return ok[back]

    # ------------------------------------------------------------ Viterbi

    def _paths(self) -> list[bool]:
        """Of each path wanted, whether it is that of the merges."""
        bpe = self.vocabulary.model == BPE
        return [True, False] if self.both and bpe else [bpe]

    def _viterbi(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words of equal length, rows of bytes: all advance one position at a time."""
        n, length = data.shape
        columns = np.ascontiguousarray(data.T)
        begins = np.ones((length + 1, n), bool)
        begins[:length] = columns & 0xC0 != 0x80
        plain = bool(begins.all())
        with np.errstate(over="ignore"):
            sums = np.zeros((length + 1, n), np.uint64)
            np.cumsum(_BYTE[columns] * powers(_BASE, length)[:length, None], axis=0, out=sums[1:])
        undo = powers(_INVERSE, length)
        paths = self._paths()
        value = np.full((length + 1, n), -np.inf)
        value[0] = 0.0
        token = [np.full((length + 1, n), -1, np.int32) for _ in paths]  # that ends here; -2: a character without a piece
        back = [np.zeros((length + 1, n), np.int32) for _ in paths]
        for end in range(1, length + 1):
            for start in range(end - 1, max(0, end - max(4, self.longest)) - 1, -1):
                size = np.uint64(end - start)
                with np.errstate(over="ignore"):
                    hashes = mix((sums[end] - sums[start]) * undo[start] + size)
                likely = self.possible[hashes >> np.uint64(44)]
                alone = None
                if plain:
                    if end - start == 1:
                        likely[:] = True
                else:
                    if end - start <= 4:  # a single character goes by its bytes if it has no piece
                        alone = ~begins[start + 1 : end].any(axis=0)
                        likely |= alone
                    likely &= begins[end] & begins[start]
                at = np.flatnonzero(likely)
                if not len(at):
                    continue
                found = self._find(hashes[at])
                if plain and end - start == 1:
                    found[found < 0] = -2
                elif alone is not None:
                    found[(found < 0) & alone[at]] = -2
                good = found != -1
                if not good.all():
                    at, found = at[good], found[good]
                for which, merges in enumerate(paths):
                    if not len(at):
                        break
                    if merges:
                        before = token[which][start, at]
                        both = (before >= 0) & (found >= 0)
                        # A character that goes by its bytes, and the word's first token, may stand beside any.
                        better = np.ones(len(at), bool)
                        if both.any():
                            better[both] = self._may_follow(before[both], found[both])
                        if start:
                            better &= before != -1
                    else:
                        score = value[start, at] + np.where(found >= 0, self.vocabulary.scores[found], self.lowest)
                        better = score > value[end, at]
                        value[end, at[better]] = score[better]
                    token[which][end, at[better]] = found[better]
                    back[which][end, at[better]] = start
        out = [self._walk_back(t, k, columns, begins) for t, k in zip(token, back)]
        return out[0] if len(out) == 1 else _side_by_side(*out)

    def _walk_back(self, token: np.ndarray, back: np.ndarray, columns: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) by the backpointers; a character without a piece gives its bytes, last first."""
        length, n = columns.shape
        if (token[length] == -1).any():
            raise AssertionError("a word without a segmentation")
        where, steps, at = np.full(n, length), [], np.arange(n)
        while len(at):
            end = where[at]
            own = token[end, at]
            single = own == -2
            steps.append((at, np.where(single, self.byte_ids[columns[end - 1, at]], own)))
            start = back[end, at]
            # Byte by byte: the rest of the character is met at its next byte.
            start[single] = end[single] - 1
            inner = single & ~begins[start, at]
            token[start[inner], at[inner]] = -2
            where[at] = start
            at = at[start > 0]
        counts = np.zeros(n, np.int64)
        for at, _ in steps:
            counts[at] += 1
        out = np.empty(int(counts.sum()), np.uint32)
        place = np.cumsum(counts)
        for at, ids in steps:
            place[at] -= 1
            out[place[at]] = ids
        return out, counts

    # ------------------------------------------------------------ long words

    def _candidates(self, data: np.ndarray, begins: np.ndarray, low: int, high: int) -> tuple[list, list, list]:
        """(ends, starts, ids) of the pieces that end after ``low`` and up to ``high``, by end, the shortest first; -2: a character without a piece."""
        span = max(4, self.longest)
        base = max(0, low - span)
        with np.errstate(over="ignore"):
            sums = np.zeros(high - base + 1, np.uint64)
            np.cumsum(_BYTE[data[base:high]] * powers(_BASE, high - base)[: high - base], out=sums[1:])
        undo = powers(_INVERSE, high - base)
        ends, starts, ids = [], [], []
        for size in range(1, span + 1):
            start = np.arange(max(base, low + 1 - size), high - size + 1)
            start = start[begins[start] & begins[start + size]]
            if not len(start):
                continue
            with np.errstate(over="ignore"):
                hashes = mix((sums[start + size - base] - sums[start - base]) * undo[start - base] + np.uint64(size))
            likely = self.possible[hashes >> np.uint64(44)]
            alone = np.zeros(len(start), bool)
            if size <= 4:
                alone[:] = True
                for k in range(1, size):
                    alone &= ~begins[start + k]
                likely |= alone
            start, alone = start[likely], alone[likely]
            found = self._find(hashes[likely])
            found[(found < 0) & alone] = -2
            good = found != -1
            ends.append(start[good] + size)
            starts.append(start[good])
            ids.append(found[good])
        end, start, found = (np.concatenate(x) for x in (ends, starts, ids))
        order = np.lexsort((-start, end))
        return end[order].tolist(), start[order].tolist(), found[order].tolist()

    def _scan(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of one long word, as :meth:`_viterbi` gives them."""
        n, paths, vocabulary = len(data), self._paths(), len(self.text)
        begins = np.ones(n + 1, bool)
        begins[:n] = data & 0xC0 != 0x80
        token, back = [array("i", [-1]) * (n + 1) for _ in paths], [array("i", [0]) * (n + 1) for _ in paths]
        value = array("d", [-np.inf]) * (n + 1)
        value[0] = 0.0
        scores, lowest = self.vocabulary.scores.tolist(), self.lowest
        for low in range(0, n, WINDOW_BYTES):
            found = self._candidates(data, begins, low, min(n, low + WINDOW_BYTES))
            for which, merges in enumerate(paths):
                own, origin = token[which], back[which]
                if merges:
                    known, get = self._known, self.new_pairs.get
                    for end, start, piece in zip(*found):
                        before = own[start]
                        if start and before == -1:
                            continue
                        if before >= 0 and piece >= 0:
                            key = before * vocabulary + piece
                            ok = get(key)
                            if ok is None:
                                ok = known(key)
                            if not ok:
                                continue
                        own[end], origin[end] = piece, start
                else:
                    for end, start, piece in zip(*found):
                        score = value[start] + (scores[piece] if piece >= 0 else lowest)
                        if score > value[end]:
                            value[end], own[end], origin[end] = score, piece, start
            if len(self.new_pairs) > KEPT_PAIRS // 4:
                self._keep_pairs()
        out = []
        for own, origin in zip(token, back):
            ids, at = array("I"), n
            while at:
                if own[at] >= 0:
                    ids.append(own[at])
                elif own[at] == -2:
                    ids.extend(self.byte_ids[data[origin[at] : at][::-1]].tolist())
                else:
                    raise AssertionError("a word without a segmentation")
                at = origin[at]
            out.append((np.array(ids, np.uint32)[::-1], np.array([len(ids)])))
        return out[0] if len(out) == 1 else _side_by_side(*out)

    def _encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
        counts, parts, order = np.zeros(len(words), np.int64), [], []
        for at in np.flatnonzero(sizes > LONG_BYTES).tolist():
            ids, counts[at : at + 1] = self._scan(data[ends[at] - sizes[at] : ends[at]])
            parts.append(ids)
            order.append(np.array([at]))
        for size in np.unique(sizes[sizes <= LONG_BYTES]).tolist():
            of_size = np.flatnonzero(sizes == size)
            most = max(1, (1 << 21) // max(1, size))
            for i in range(0, len(of_size) if size else 0, most):
                at = of_size[i : i + most]
                ids, counts[at] = self._viterbi(data[(ends[at] - size)[:, None] + np.arange(size)])
                parts.append(ids)
                order.append(at)
        held = np.concatenate([np.empty(0, np.uint32), *parts])
        at = np.concatenate([np.empty(0, np.int64), *order])
        starts = np.zeros(len(words), np.int64)
        starts[at] = np.cumsum(counts[at]) - counts[at]
        return held[ragged(starts, counts)], counts

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        cut = [re.findall(" +[^ ]*|[^ ]+", f" {t}") for t in texts]
        words = pa.array(dict.fromkeys(w for x in cut for w in x), pa.string())
        ids, counts = self._encode_words(words)
        ends = np.cumsum(counts)
        own = {w: ids[e - c : e] for w, e, c in zip(words.to_pylist(), ends.tolist(), counts.tolist())}
        return [np.concatenate([own[w] for w in x]) for x in cut]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, bounds); empty and null texts have no id."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        ids, bounds = super().encode(texts)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if empty.any():  # there is no space before nothing
            counts = np.diff(bounds)
            ids = ids[~np.repeat(empty, counts)]
            counts[empty] = 0
            bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The texts' bytes; the dummy prefix is taken off."""
        lengths = np.diff(self.decode_ends, prepend=0)
        counts = lengths[ids]
        data = self.decode_pool[ragged(self.decode_ends[ids] - counts, counts)].tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)])[bounds].tolist()
        return [data[a + 1 : z] if data[a : a + 1] == b" " else data[a:z] for a, z in zip(ends, ends[1:])]


def _side_by_side(merged: tuple[np.ndarray, np.ndarray], best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's ids of the one path, then those of the other, marked."""
    (ids, counts), (more, extra) = merged, best
    out = np.empty(len(ids) + len(more), np.uint32)
    begin = np.cumsum(counts + extra) - counts - extra
    out[ragged(begin, counts)] = ids
    out[ragged(begin + counts, extra)] = more | BEST
    return out, counts + extra


def split_paths(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bounds, ids, bounds): the merges' path and that of the largest score, from an encoder of ``both``."""
    marked = ids >= BEST
    before = np.concatenate([[0], np.cumsum(marked)])[bounds]
    return ids[~marked], bounds - before, ids[marked] ^ BEST, before


@lru_cache(maxsize=2)
def piece_encoder(path: str, both: bool = False) -> PieceEncoder:
    """This worker's encoder for the vocabulary at ``path``."""
    return PieceEncoder(path, both)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Whole texts encoded and decoded again: ``id_col, ids, n_pieces, ids_crc32, decoded_bytes, decoded_sha256, exact, n_best, best_crc32``.

    ``ids`` are the library's.  ``n_best`` and ``best_crc32`` are of the segmentation of the
    largest summed score; for a unigram vocabulary they are of the same ids.  ``exact``: the decoded
    bytes of both are the text's (not so where a text has the escape U+2581, which stands for a space).
    Null and empty texts have no pieces.  A null id is kept, repeated rows repeat, an empty table stays
    empty, other columns are ignored.  Without ``keep_ids`` ids are left null.
    """
    schema = "id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_bytes long, decoded_sha256 string, exact boolean, n_best long, best_crc32 long"

    def crc(ids: np.ndarray, ends: list[int]) -> pa.Array:
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(ends, ends[1:])], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker(keep="pieces")
        made = piece_encoder(model, True)
        for b in batches:
            row = 0
            for texts in slices(b.column(1)):
                ids, bounds = made.encode(texts)
                ids, bounds, best, best_bounds = split_paths(ids, bounds) if len(made._paths()) > 1 else (ids, bounds, ids, bounds)
                decoded, again = made.decode(ids, bounds), made.decode(best, best_bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))) if keep_ids else pa.nulls(len(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(row, len(texts)), lists, pa.array(np.diff(bounds), pa.int64()),
                        crc(ids, bounds.tolist()), pa.array([len(d) for d in decoded], pa.int64()), pa.array([sha256(d).hexdigest() for d in decoded]),
                        pa.array([d == e == t.encode() for d, e, t in zip(decoded, again, texts.to_pylist())]),
                        pa.array(np.diff(best_bounds), pa.int64()), crc(best, best_bounds.tolist()),
                    ],
                    [x.split()[0] for x in schema.split(", ")],
                )
                row += len(texts)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` of rows with piece ids; null ids give a null text, bytes that aren't UTF-8 the replacement character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = piece_encoder(model)
        for b in batches:
            lists = b.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            found = made.decode(lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(counts)]))
            texts = [None if missing else d.decode("utf-8", "replace") for d, missing in zip(found, pc.is_null(lists).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), ids_col).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
