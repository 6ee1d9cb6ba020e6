"""Token ids of whole texts by the tokenizers library, a batch of texts at a time.

A byte-level BPE with the common pre-tokenizer pattern starts a token at every space that follows a
non-space or precedes one, so a text may be cut before such spaces and its words be encoded on
their own.  Words recur, so each worker keeps the ids of those it has met (at most ``CACHED``) and
asks the library only for new ones.  Texts with a space between two other white-space characters,
or at the end after one, or with the string of an added token, which the library takes as that token,
are given to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import word_digests

#: Words that a worker keeps; words that are encoded as one text; bytes of text that are encoded at once.
CACHED, JOINED, SLICE_BYTES = 1_500_000, 500, 4 << 20
_SPACE = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"{_SPACE} (?:{_SPACE}|$)"
_PLAIN = f"^ (?s:.*)[^{_SPACE[1:]}$"


def slices(texts: pa.StringArray, most: int = SLICE_BYTES) -> Iterator[pa.StringArray]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + counts[i] - 1`` for each i, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class WordEncoder:
    """Encodes arrays of texts word by word; ``encode`` gives the ids and each text's bounds in them.

    Subclasses say which texts are ``odd`` and go whole, and encode distinct words.
    """

    odd: str
    #: Whether a text's first word has a space before it like the others.
    first_spaced = False
    cached = CACHED

    def __init__(self) -> None:
        self.pool, self.starts = np.empty(1 << 20, np.uint32), np.zeros(1 << 16, np.int64)
        self.forget()

    def forget(self) -> None:
        """Drop the words that are kept: their hashes in order, a second hash, and their places in ``starts``."""
        self.word_keys, self.word_seconds, self.word_places, self.kept_used = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def _encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct words, each with the space before it."""
        raise NotImplementedError

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def _slots(self, words: pa.StringArray) -> np.ndarray:
        """Places of distinct words in the pool.  Once ``cached`` words are kept, others stay for this call only."""
        used, n = self.kept_used, len(self.word_keys)
        first, second = word_digests(words)
        found = np.full(len(words), -1, np.int64)
        if n:
            at = np.minimum(np.searchsorted(self.word_keys, first), n - 1)
            found = np.where((self.word_keys[at] == first) & (self.word_seconds[at] == second), self.word_places[at], -1)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        new = words.take(pa.array(missing))
        ids, counts = self._encode_words(new)
        while n + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        if used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(len(ids), len(self.pool) // 2), np.uint32)])
        self.pool[used : used + len(ids)] = ids
        self.starts[n + 1 : n + 1 + len(new)] = used + np.cumsum(counts)
        found[missing] = np.arange(n, n + len(new))
        keep = max(0, min(len(new), self.cached - n))
        by = missing[:keep][np.argsort(first[missing[:keep]], kind="stable")]
        at = np.searchsorted(self.word_keys, first[by])
        self.word_keys, self.word_seconds, self.word_places = (np.insert(x, at, y[by]) for x, y in ((self.word_keys, first), (self.word_seconds, second), (self.word_places, found)))
        self.kept_used = int(self.starts[len(self.word_keys)])
        return found

    def _plain(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(texts, " ")
        bounds = words.offsets.to_numpy()
        flat = words.flatten()
        bounds = bounds - bounds[0]
        spaced = pc.binary_join_element_wise(pa.scalar(""), flat, " ")
        if not self.first_spaced:
            first = np.zeros(len(flat), bool)
            first[bounds[:-1]] = True
            spaced = pc.if_else(pa.array(first), flat, spaced)
        coded = spaced.dictionary_encode()
        slot = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        counts = self.starts[slot + 1] - self.starts[slot]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[ragged(self.starts[slot], counts)], ends[bounds]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, bounds as int64, one more than texts); a null text is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False).astype(bool)
        if not odd.any():
            return self._plain(texts) if len(texts) else (np.empty(0, np.uint32), np.zeros(1, np.int64))
        ids, counts = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64)
        if (~odd).any():
            own, bounds = self._plain(texts.filter(pa.array(~odd)))
            ids, counts[~odd] = [own], np.diff(bounds)
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist())
        counts[odd] = [len(x) for x in whole]
        held = np.concatenate(ids + whole)
        starts = np.zeros(len(texts), np.int64)
        starts[~odd] = np.cumsum(counts[~odd]) - counts[~odd]
        starts[odd] = len(ids[0]) + np.cumsum(counts[odd]) - counts[odd]
        return held[ragged(starts, counts)], np.concatenate([[0], np.cumsum(counts)])


class TextEncoder(WordEncoder):
    """The tokenizers library with a byte-level vocabulary."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.odd = "|".join([_ODD, *map(re.escape, added)])
        self.token_bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.token_bytes[i] = len(token)  # a byte-level vocabulary has a letter for each byte

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self._library(texts)]

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 64):
            for x in self.tokenizer.encode_batch_fast(texts[i : i + 64], add_special_tokens=False):
                yield x.ids

    def _encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): words that a space begins and no space ends are encoded many at a time and told apart by their bytes."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        joined = words if plain.all() else words.filter(pa.array(plain))
        texts = joined.to_pylist()
        got = [np.array(x, np.uint32) for x in self._library(["".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])]
        ids = np.concatenate([np.empty(0, np.uint32), *got])
        ends = np.cumsum(pc.binary_length(joined).to_numpy(), dtype=np.int64)
        token_ends = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(token_ends, ends)
        if len(ends) and not (token_ends[last] == ends).all():
            raise ValueError("the vocabulary joins words across a space")
        counts = np.diff(last, prepend=-1)
        if plain.all():
            return ids, counts
        own = [np.array(x, np.uint32) for x in self._library(words.filter(pa.array(~plain)).to_pylist())]
        every, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        every[plain], every[~plain] = counts, [len(x) for x in own]
        starts[plain] = np.cumsum(counts) - counts
        starts[~plain] = len(ids) + np.cumsum(every[~plain]) - every[~plain]
        return np.concatenate([ids, *own])[ragged(starts, every)], every


@lru_cache(maxsize=1)
def encoder(path: str, cached: int = CACHED) -> TextEncoder:
    """This worker's encoder for the vocabulary at ``path``, which keeps so many words."""
    made = TextEncoder(path)
    made.cached = cached
    return made
