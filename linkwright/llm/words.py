"""Words, shingles and their hashes, as arrays. Words are maximal runs of [^\\x20\\x09-\\x0D], which is what bytes.split finds."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_MIX = U64(0xD6E8FEB86659FD93)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text in UTF-8; lower folds A-Z only. None has no words."""
    raw = (text or "").encode("utf-8")
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * _MIX
    x = (x ^ (x >> U64(29))) * _ODD
    return x ^ (x >> U64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive words; none if there are fewer."""
    count = len(hashes) - n + 1
    if count < 1:
        return np.empty(0, U64)
    total = np.full(count, U64(n), U64)
    for i in range(n):
        total = total * _ODD + hashes[i : i + count]
        total ^= total >> U64(31)
    return mix(total)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the lower-cased text; a text of fewer words is one shingle."""
    hashes = word_hashes(words_of(text, lower=True))
    return np.unique(ngram_hashes(hashes, min(n, len(hashes)))) if len(hashes) else np.empty(0, U64)


def covered(starts: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Which of n_words words lie in a window of `width` words that begins at one of starts."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n_words), -1)
    return np.cumsum(edge)[:n_words] > 0
