"""Hashes of words and word shingles over whole Arrow batches, in numpy.

Words are runs of bytes other than white space (0x20, 0x09 to 0x0D) of the
text with A-Z lower-cased. Hashes have 64 bits; texts are taken whole, and
long ones are worked on in pieces cut at white space.
"""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 20
_B = 0x9E3779B97F4A7C15 | 1
_INV = pow(_B, -1, 1 << 64)
_K = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _K[0]
    h = (h ^ (h >> np.uint64(27))) * _K[1]
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _PIECE + 4096)
        out = []
        for b in (_B, _INV):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def _piece(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and starts in a piece; ``breaks`` are positions at which a new document begins."""
    n = len(raw)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[breaks] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[breaks[breaks > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    value = (total[ends] - total[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _K[2]), starts


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the len + 1 offsets of each text's words."""
    hashes, starts, lo, total = [], [], 0, len(raw)
    while lo < total:
        hi = min(total, lo + _PIECE)
        while hi < total:  # cut after white space or between texts
            tail = raw[max(lo, hi - 4096):hi]
            gaps = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
            if len(gaps):
                hi = hi - len(tail) + int(gaps[-1]) + 1
                break
            hi = min(total, hi + _PIECE)
        first, last = np.searchsorted(offsets, [lo, hi])
        inner = np.unique(offsets[first:last] - lo)
        h, s = _piece(raw[lo:hi], inner[inner < hi - lo])
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of every text, ascending: ``size`` words each, or all the words of a text that has fewer."""
    n = len(h)
    wide = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    for j in range(size):
        wide = wide * _K[3] + mix(h[j:j + len(wide)] + _K[j % 5])
    wide = mix(wide)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            own = np.sort(wide[a:b - size + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            x = np.zeros(1, np.uint64)
            for w in h[a:b]:
                x = x * _K[4] + mix(np.array([w], np.uint64))
            own = mix(x + np.uint64(b - a))
        else:
            own = wide[:0]
        out.append(own)
    return out
