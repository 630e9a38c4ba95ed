"""Words and hashed word runs of texts, in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Everything that is neither letter, digit nor blank; ``_`` is matched by ``\w`` but is no letter.
_DROP = re.compile(r"[^\w\s]|_")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_LIMIT = 500_000
_cache: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    """Lower-case, drop what is not a letter, digit or blank, split at blanks."""
    return _DROP.sub("", text.lower()).split()


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    if len(_cache) > _CACHE_LIMIT:
        _cache.clear()
    found = list(map(_cache.get, words))
    if None in found:
        for i, h in enumerate(found):
            if h is None:
                found[i] = _cache[words[i]] = xxhash.xxh64_intdigest(words[i])
    return np.array(found, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, by start position."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = mix(h * _MIX + hashes[i : i + n])
    return h


def distinct_runs(texts: list[list[str]], k: int, mask: np.uint64) -> list[np.ndarray]:
    """The masked hashes of the distinct runs of ``k`` words of each text, in order; texts are hashed and sorted together."""
    n = np.array([len(t) for t in texts], np.int64)
    h = run_hashes(word_hashes([w for t in texts for w in t]), k) & mask
    own = np.repeat(np.arange(len(texts)), n)
    inside = own[: len(h)] == own[len(own) - len(h) :]
    h, own = h[inside], own[: len(h)][inside]
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return np.split(h, np.searchsorted(own, np.arange(1, len(texts))))
