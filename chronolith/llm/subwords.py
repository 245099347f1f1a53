"""Hashed subword features, and values of words that a task remembers."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def grams(words: list[bytes], sizes: tuple[int, ...], buckets: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each byte n-gram of ``<word>``; all words at once."""
    whole = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    found = []
    for n in sizes:
        if len(whole) < n:
            continue
        h = np.full(len(whole) - n + 1, n + 16 * salt, np.uint64)
        for j in range(n):
            h = (h ^ whole[j : j + len(h)]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(33)
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        own = owner[: len(h)]
        inside = own == owner[n - 1 :]
        found.append((own[inside], ((h[inside] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def whole_words(words: list[bytes], buckets: int, salt: int) -> np.ndarray:
    """A bucket for each word itself."""
    return np.fromiter((zlib.crc32(w, salt) % buckets for w in words), np.int64, len(words))


class WordTable:
    """Rows of numbers for words, computed once for each distinct word until ``most`` words are known; then it starts anew."""

    def __init__(self, compute: Callable[[list[bytes]], np.ndarray], width: int, most: int = 250_000):
        self.compute, self.width, self.most = compute, width, most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.width))

    def begin(self) -> None:
        """Starts anew if it is full."""
        if len(self.known) > self.most:
            self.forget()

    def ids(self, words: list[bytes], forget: bool = True) -> np.ndarray:
        """Numbers of the words, good until the next call, or without ``forget`` until it forgets."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if forget and len(self.known) + len(new) > self.most and self.known:
            self.forget()
            new = list(dict.fromkeys(words))
        if new:
            base = len(self.known)
            while len(self.table) < base + len(new):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[base : base + len(new)] = self.compute(new)
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def rows(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids(words)
        return self.table[ids]


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the next ``counts[i]`` values for each i; a sum doesn't depend on its neighbours."""
    out = np.zeros((len(counts), *values.shape[1:]))
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def sampled(column: Column, share: float) -> Column:
    """True for about ``share`` of the values, always the same ones."""
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))
