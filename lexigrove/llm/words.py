"""Words, their hashes and runs of words, many texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A longest run of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[^>]*>")

#: Distinct words whose hashes a Python worker keeps.
CACHE_WORDS = 1_000_000

_MULTIPLIER = 0x9E3779B97F4A7C15


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes(dict):
    """word -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def runs(codes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of n codes, its text, its position), texts one after the other in codes; no run crosses texts."""
    if len(codes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(codes) - n + 1
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h *= np.uint64(_MULTIPLIER)
        h += codes[k : k + size]
    text = np.repeat(np.arange(len(lengths)), lengths)
    start = np.cumsum(lengths) - lengths
    keep = np.flatnonzero(text[:size] == text[n - 1 :])
    return mix(h[keep]), text[keep], keep - start[text[keep]]
