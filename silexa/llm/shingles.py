"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once.

A text is lower-cased in A-Z and cut at blanks and tab to carriage return; its set holds the hashes of all runs of ``size`` words; a shorter text
has one shingle, its whole sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np

from .common import RangeHash, mix

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """One sorted array of distinct hashes for each text."""
    joined = (b" ".join(texts) + b" ").translate(_LOWER)
    data = np.frombuffer(joined, dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = RangeHash(data)(start, stop)
    owner = np.searchsorted(ends, start, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            runs += words[k : k + len(runs)] * _FACTORS[k]
        runs = mix(runs + np.uint64(size))
    out = []
    for i, n in enumerate(counts.tolist()):
        a = int(first[i])
        if n >= size:
            out.append(np.unique(runs[a : a + n - size + 1]))
        elif n:
            out.append(mix((words[a : a + n] * _FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
