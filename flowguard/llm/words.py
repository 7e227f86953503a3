"""Word hashes of many texts at once, and mixing of 64-bit numbers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import xxhash

from flowguard.llm.common import WORD

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent of one another."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words; those seen are looked up, up to ``remember`` of them."""

    def __init__(self, fold_case: bool = False, remember: int = 200_000):
        self.seen: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)
        self.fold_case, self.remember = fold_case, remember

    def of(self, split: list[list[str]]) -> np.ndarray:
        """Hashes of all words in turn; a word's number is its place in a table of hashes."""
        if len(self.seen) > self.remember:
            self.seen, self.hashes = {}, np.zeros(0, np.uint64)
        seen, fresh = self.seen, set()
        for words in split:
            fresh.update(words)
        fresh = list(fresh.difference(seen))
        keys = (w.translate(ASCII_LOWER) for w in fresh) if self.fold_case else fresh
        made = np.array([xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64)
        seen.update(zip(fresh, range(len(seen), len(seen) + len(fresh))))
        self.hashes = np.concatenate([self.hashes, made])
        total = sum(map(len, split))
        place = np.fromiter(map(seen.__getitem__, chain.from_iterable(split)), np.int64, total)
        return self.hashes[place]

    def texts(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts in turn, and for each text how many."""
        split = [WORD.findall(t) for t in values]
        return self.of(split), np.fromiter(map(len, split), np.int64, len(split))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, for every place where one starts (across texts too)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out *= ODD
        out += hashes[j:j + size]
        out ^= out >> np.uint64(29)
    return mix(out)


def per_text(values: np.ndarray, counts: np.ndarray, fn: Callable) -> list:
    """``fn`` of each text's slice."""
    ends = np.cumsum(counts)
    return [fn(values[e - c:e]) for e, c in zip(ends.tolist(), counts.tolist())]
