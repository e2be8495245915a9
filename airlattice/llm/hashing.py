"""Hashes of words and shingles in numpy, for tasks that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest as _digest  # every worker must have it: hashes of different machines meet

from .words import SHINGLE

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: a worker that has done one task waits for the next with what it holds."""
    pa.default_memory_pool().release_unused()
    if _trim:  # glibc
        _trim(0)


class WordIds(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = _digest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(ids: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all windows of ``length`` words, in order; a shorter text has one, all of it; an empty one none."""
    if not len(ids):
        return ids
    length = min(length, len(ids))
    n = len(ids) - length + 1
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = mix(out) + ids[i : i + n]
    return np.unique(mix(out))


def texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    """The texts of a batch as bytes; null is empty."""
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""
