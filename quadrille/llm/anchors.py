"""Content-defined anchors over byte buffers (numpy kernels, no Spark).

Every window of ``length`` bytes selects the smallest ``gram``-byte hash inside
it as its *anchor*.  The choice depends only on the window's own bytes, so equal
windows in different documents select the same relative position, and only
about ``2 / (length - gram + 2)`` of all positions are ever selected.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_M3 = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash columns."""
    with np.errstate(over="ignore"):
        z = a * _M3 + np.uint64(0x2545F4914F6CDD1D)
        z ^= z >> np.uint64(32)
        z += b
        z *= _M1
        z ^= z >> np.uint64(29)
        z *= _M2
        z ^= z >> np.uint64(32)
    return z


def window_hash(buf: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``buf[i:i+n]`` for every start i, by doubling (log2 n passes)."""
    if len(buf) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        cur = (buf.astype(np.uint64) + np.uint64(1)) * _M1
    size, out, have = 1, None, 0
    while True:
        if n & size:
            out = cur if out is None else _mix(out[: len(buf) - have - size + 1], cur[have : len(buf) - size + 1])
            have += size
        if have == n:
            return out
        cur = _mix(cur[: len(cur) - size], cur[size:])
        size *= 2


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Leftmost position of the minimum of ``h[i:i+w]`` for every start i."""
    val, idx, size = h, np.arange(len(h), dtype=np.int32 if len(h) < 2**31 else np.int64), 1
    while size < w:
        step = min(size, w - size)
        left, right = val[:-step], val[step:]
        take = right < left
        val = np.where(take, right, left)
        idx = np.where(take, idx[step:], idx[:-step])
        size += step
    return idx


def anchors(buf: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that select the same anchor.

    Returns (first start, last start, anchor position, hash of the gram at the
    anchor); every start 0..len(buf)-length lies in exactly one run.
    """
    if len(buf) < length:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    h = window_hash(buf, gram)
    at = window_argmin(h, length - gram + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    first = np.concatenate(([0], cut)).astype(np.int64)
    last = np.concatenate((cut - 1, [len(at) - 1])).astype(np.int64)
    pos = at[first].astype(np.int64)
    return first, last, pos, h[pos]
