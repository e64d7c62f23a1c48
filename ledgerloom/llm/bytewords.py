"""Words of Arrow string columns as 64-bit hashes, computed on the byte buffer with NumPy.

A word is a maximal run of ``a-z0-9`` in a text that is already lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_M_INV = np.uint64(pow(int(_M), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, first word index of each row plus the total). Null rows have no words."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=texts.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi]
    bounds = offsets - lo
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds[:-1]] = True
    edge[-1] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(stop) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_M, len(data), "m"), out=sums[1:], dtype=np.uint64)
    raw = (sums[e] - sums[s]) * _power(_M_INV, len(data), "i")[s]
    hashes = mix(raw ^ ((e - s).astype(np.uint64) << np.uint64(56)))
    return hashes, np.searchsorted(s, bounds).astype(np.int64)


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words that stays inside its row, first run index of each row plus the total)."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, dtype=np.uint64), starts
    at = np.arange(total) - np.repeat(starts[:-1], counts) + np.repeat(first[:-1], counts)
    h = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(3) + words[at + k])
    return h, starts
