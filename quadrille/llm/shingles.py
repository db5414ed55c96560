"""Sets of word shingles and their SimHash bits, for many texts at once (numpy kernels, no Spark).

Words are lower-cased for A-Z and separated by ASCII white space.  A word's hash
sums a random value a byte, weighted by the byte's place; a shingle's hash mixes
the hashes of its words.  Texts of fewer words than a shingle have one, the whole
sequence.
"""

from __future__ import annotations

import numpy as np

from .anchors import _mix

_PIECE = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(1)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
#: Weights by place in a word; longer words repeat them.
_PLACE = _RANDOM.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0xD6E8FEB86659FD93)


def _word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of every word."""
    space = _SPACE[buf]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(first):
        return np.empty(0, np.uint64), first
    place = np.arange(len(buf)) - np.concatenate((np.zeros(first[0], np.int64), np.repeat(first, np.diff(np.append(first, len(buf))))))
    with np.errstate(over="ignore"):
        value = _BYTE[buf] * _PLACE[place & 1023]
        value[space] = 0
        # the place is mixed in, so bytes 1,024 places apart do not commute
        far = place > 1023
        if far.any():
            value[far] = _mix(value[far], (place[far] >> 10).astype(np.uint64)) * ~space[far]
        h = np.add.reduceat(value, first)
    return _mix(h, h >> np.uint64(32)), first


def _pieces(data: bytes):
    """Cut at white space into pieces of about ``_PIECE`` bytes (a longer word stays whole)."""
    buf, a = np.frombuffer(data, np.uint8), 0
    while a < len(buf):
        z = min(len(buf), a + _PIECE)
        while z < len(buf) and not _SPACE[buf[z]]:
            ahead = _SPACE[buf[z : z + _PIECE]]
            z += int(np.argmax(ahead)) if ahead.any() else len(ahead)
        yield buf[a:z]
        a = z


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    words, starts, at = [], [], 0
    for buf in _pieces(b" ".join(data)):
        h, first = _word_hashes(buf)
        words.append(h)
        starts.append(first + at)
        at += len(buf)
    word = np.concatenate(words) if words else np.empty(0, np.uint64)
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    last = np.searchsorted(start, ends)
    out, a = [], 0
    rolled = word[: max(0, len(word) - width + 1)]
    for k in range(1, width):
        rolled = _mix(rolled, word[k : k + len(rolled)])
    for z in last.tolist():
        n = z - a
        if n >= width:
            out.append(np.unique(rolled[a : z - width + 1]))
        elif n:
            h = word[a : a + 1] ^ _SHORT
            for k in range(a + 1, z):
                h = _mix(h, word[k : k + 1])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        a = z
    return out


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def sketches(sets: list[np.ndarray], size: int) -> list[bytes]:
    """``size`` SimHash bits of each set: the signs of a sum of one pseudo-random +-1 vector mix a member.

    A member adds three signed units to ``size`` cells; a Hadamard transform spreads
    them over all places, and a fixed permutation parts the places that it ties.
    """
    side = 1 << (size.bit_length() // 2)
    left, right = _hadamard(size // side), _hadamard(side)
    order = np.random.default_rng(2).permutation(size)
    bits = size.bit_length() - 1
    out: list[bytes] = []
    for lo in range(0, len(sets), 512):
        part = sets[lo : lo + 512]
        cells = np.zeros(len(part) * size, np.float64)
        # members of several sets at a time, so that memory follows the sets, not their number
        h = np.concatenate(part)
        h = _mix(h, h >> np.uint64(31))
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        for k in range(3):
            field = (h >> np.uint64(k * (bits + 1))).astype(np.int64)
            sign = 1.0 - 2.0 * ((field >> bits) & 1)
            cells += np.bincount(row * size + (field & (size - 1)), weights=sign, minlength=len(cells))
        y = left @ cells.astype(np.float32).reshape(len(part), size // side, side) @ right
        packed = np.packbits(y.reshape(len(part), size)[:, order] > 0, axis=1)
        out += [row.tobytes() for row in packed]
    return out
