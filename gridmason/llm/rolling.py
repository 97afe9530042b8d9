"""Rolling hashes and window minima over many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


@lru_cache(1)
def _units() -> np.ndarray:
    return mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x1234567))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k units (bytes or code points), equal for equal runs anywhere; len(units) - k + 1 of them."""
    n = len(units)
    if n < k:
        return np.zeros(0, np.uint64)
    size = 1 << max(16, (n + 1).bit_length())
    up, down = _powers(size)
    v = _units()[units] if units.dtype == np.uint8 or int(units.max(initial=0)) < 1 << 16 else mix(units.astype(np.uint64) + np.uint64(0x1234567))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(v * down[:n], out=s[1:])
    return mix((s[k:] - s[:-k]) * up[: n - k + 1])


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """min(keys[i : i + w]) for every i with a whole window: log2(w) passes."""
    out, have = keys, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions, ascending and different, of the smallest hash (its upper 32 bits) of every window of w; of equals the rightmost.
    Fewer than w hashes are one window. At most 2 ** 32 hashes."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    best = sliding_min(keys, min(w, n))
    best = best[np.flatnonzero(np.diff(best, prepend=~best[:1]))]
    return np.int64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
