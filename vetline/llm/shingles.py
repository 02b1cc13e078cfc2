"""Word shingle hashes, the same in every worker."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.random.default_rng(20240229).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MEMO_WORDS = 400_000
_MEMO: dict[bytes, int] = {}


def finalise(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hash of each word (run of bytes other than 0x20, 0x09-0x0D)."""
    words = raw.split()
    found = list(map(_MEMO.get, words))
    if None in found:
        if len(_MEMO) > MEMO_WORDS:
            _MEMO.clear()
        for i, h in enumerate(found):
            if h is None:
                found[i] = _MEMO[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(found, np.uint64)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of ``k`` words."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _ODD[0]
    for i in range(1, k):
        total = total + hashes[i:i + n] * _ODD[i % 64]
    return finalise(total + np.uint64(k))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles of a text lower-cased in A-Z; a text
    of fewer words is one shingle, one without words has none."""
    hashes = word_hashes((text or "").encode().lower())
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(k, len(hashes))))
