"""Landmarks of a text from a rolling hash over its code points."""

from __future__ import annotations

import numpy as np

#: Code points that a landmark depends on.
SPAN = 32
_M = np.uint64(0x9E3779B97F4A7C15)
_X = np.uint64(0xD6E8FEB86659FD93)
#: _M to the powers of 1, 2, 4, 8 and 16.
_POWERS = [(k, np.uint64(pow(int(_M), k, 2**64))) for k in (1, 2, 4, 8, 16)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def rolling(codes: np.ndarray) -> np.ndarray:
    """At each position, a polynomial hash of the SPAN code points that end there (fewer at the start)."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * _X
    h ^= h >> np.uint64(31)
    for k, power in _POWERS:
        if len(h) > k:
            longer = h.copy()
            longer[k:] += h[:-k] * power
            h = longer
    return h


def landmarks(codes: np.ndarray, every: int) -> np.ndarray:
    """Positions after which a cut may fall, one in about `every`; an edit moves only those within SPAN of it."""
    bits = max(1, int(round(np.log2(max(2, every)))))
    return np.flatnonzero(rolling(codes) >> np.uint64(64 - bits) == 0) + 1
