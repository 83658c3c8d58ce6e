"""Hashed word shingles of UTF-8 texts, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes."""
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * _K1 + h[i : i + n])
    return out


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    return np.unique(windows(h, min(k, len(words))))


def binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def batches(it: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    for b in it:
        if b.num_rows:
            yield [binary(b.column(c)) if pa.types.is_string(b.schema.field(c).type) or pa.types.is_large_string(b.schema.field(c).type) else b.column(c).to_pylist() for c in columns]
