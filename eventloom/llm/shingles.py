"""64-bit hashes of five-word shingles, for the operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str, width: int = WORDS) -> np.ndarray:
    """One hash for each run of ``width`` words, in text order, repeats kept.

    Words are runs of characters other than space and U+0009 to U+000D (those that
    bytes.split() splits at). A text with fewer words is one shingle; without words, none.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    # Hashing a word takes less time than finding it among kept ones.
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * _STEP + h[k : k + n])
    return out
