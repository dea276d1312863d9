"""Word shingles and MinHash signatures of whole texts, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WORDS = 5
#: Words a worker keeps with their hashes; when full, the table starts anew.
CACHE_WORDS = 500_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class WordHashes(dict):
    """64-bit hashes of words, made on first sight."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


_hashes = WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[3]
    h = (h ^ (h >> np.uint64(29))) * _ODD[4]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted (uint64).

    Words are the lower-cased runs between white space.  A text of fewer words
    than a shingle is one shingle; one without words has none.
    """
    split = (text or "").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, split), dtype=np.uint64, count=len(split))
    n = max(1, len(w) - words + 1)
    h = np.full(n, np.uint64(min(len(w), words)))
    for k in range(min(words, len(w))):
        h = _mix((h + _ODD[0]) * _ODD[1] + w[k : k + n] * _ODD[2])
    return np.unique(h)


def permutations(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of ``k`` hash functions."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minhash(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature of a non-empty set: the least upper half of each permuted hash, as int32."""
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[i : i + 2048, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets without repeats, not both empty."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)
