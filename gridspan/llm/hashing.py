"""Hashes of all tokens of a text at once, from prefix sums over its bytes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: By byte: letters, digits and whatever isn't ASCII / anything but ASCII white space.
WORDS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
PRINTED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def hashed_spans(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes that are inside; equal
    runs, equal hashes, of which none is 0 but by chance.

    A run's hash is its polynomial in BASE modulo 2 ** 64, got from two prefix sums and
    the inverse of a power of BASE, so no token is handled by itself.
    """
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(inside[raw].astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", BASE, n), out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * _power("down", pow(BASE, -1, 1 << 64), n)[starts])


def token_hashes(data: bytes, inside: np.ndarray) -> np.ndarray:
    """The hashes of hashed_spans()."""
    return hashed_spans(data, inside)[2]
