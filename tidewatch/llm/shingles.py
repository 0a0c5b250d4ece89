"""Hashes of words and of word shingles, a batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from tidewatch.llm.common import remembered, words_of

WORD_CACHE = 300_000
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Remembers the 64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES = remembered(WordHashes())


def hashes_of(words: list[bytes]) -> np.ndarray:
    return HASHES.of(words)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all bits of the input."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` word hashes; none if there are fewer."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = words[:n].copy()
    for j in range(1, size):
        acc *= STEP
        acc += words[j : j + n]
    return mix(acc)


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words the whole sequence is one."""
    for raw in texts:
        words = HASHES.of(words_of(raw))
        if 0 < len(words) < size:
            yield mix(rolling(words, len(words)) + np.uint64(len(words)))
        else:
            yield np.unique(rolling(words, size))


def chunks(texts: list[bytes], most: int = 3 << 20) -> Iterator[slice]:
    """Slices of about `most` bytes of text, one text at least."""
    start = held = 0
    for i, raw in enumerate(texts):
        if i > start and held + len(raw) > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(raw)
    if start < len(texts):
        yield slice(start, len(texts))
