"""Vectorised word and shingle hashes over UTF-8 bytes (numpy, used inside tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased (A-Z only) text; a shingle is
five consecutive words, and a text with one to four words has its whole sequence as
its only shingle.  Equal words always have equal hashes; different ones collide with
a chance of about 2**-60 per compared pair.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
SPAN = 1 << 18  # bytes of text hashed at once
_rng = np.random.default_rng(20240229)
WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[WS] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POS = _rng.integers(1, 2**64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_power = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        p = np.full(max(n, 64, 2 * len(_power)), _BASE)
        p[0] = 1
        _power = np.multiply.accumulate(p)
    return _power


def words(texts: list[bytes], blank: np.ndarray = WS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text plus the end, first byte and end
    byte of each word in the newline-joined texts).  ``blank``: which bytes are no words."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ws = blank[a]
    edge = np.flatnonzero(np.diff(ws, prepend=True))
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
    if not len(start):
        return np.zeros(0, np.uint64), bounds, start, end
    n = end - start
    h, power = np.empty(len(n), np.uint64), _powers(int(n.max()))
    # whole words, of about SPAN bytes together: a byte takes some 40 times its size for a moment
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, len(a), SPAN)), len(n))).tolist()
    for i, j in zip(cuts[:-1], cuts[1:]):
        here, m = slice(start[i], end[j - 1]), n[i:j]
        inside = np.flatnonzero(~ws[here])
        first = np.cumsum(m) - m
        off = np.arange(len(inside)) - np.repeat(first, m)
        h[i:j] = np.add.reduceat(_BYTE[a[here][inside]] * power[off], first)
    return mix(h + n.astype(np.uint64)), bounds, start, end


def window_hashes(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Order-aware hash of each run of ``width`` consecutive word hashes."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    s = np.zeros(m, np.uint64)
    for j in range(width):
        s += mix(h[j:j + m] + _POS[j]) * _POS[j]
    return mix(s)


def shingles(h: np.ndarray) -> np.ndarray:
    """All shingles of one text in order (with repeats)."""
    if 0 < len(h) < SHINGLE:
        return mix(window_hashes(h, len(h)) + np.uint64(len(h)))
    return window_hashes(h)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    h, bounds, _, _ = words(texts)
    grams = window_hashes(h)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        out.append(np.unique(grams[a:b - SHINGLE + 1] if b - a >= SHINGLE else shingles(h[a:b])))
    return out
