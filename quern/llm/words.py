"""Words of a text and their hashes, as arrays over whole Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

_WORDS = re.compile(r"[^\W_]+").findall
#: Hashes kept per Python worker; the cache is emptied when it is full.
CACHE_WORDS = 400_000
#: Characters of text that are turned into arrays at once.
CHUNK_CHARS = 4_000_000
_STEP = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASH = _Hashes()


def words(text: str | None) -> list[str]:
    """Maximal runs of Unicode letters and digits, in lower case; none for null."""
    return _WORDS(text.lower()) if text else []


def hashes(tokens: Sequence[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(_HASH.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def powers(n: int) -> np.ndarray:
    return np.array([pow(_STEP, k + 1, 1 << 64) for k in range(n)], dtype=np.uint64)


def window_hashes(h: np.ndarray, n: int, mask: Sequence[int] | None = None) -> np.ndarray:
    """Hash of every window of n words over the positions of ``mask`` (default: all)."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(h) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    by = powers(n)
    for k in range(n) if mask is None else mask:
        out += h[k : k + size] * by[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` characters together; one row at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)
