"""Hashes of words and of byte strings, over whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial and of the finaliser.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, np.uint64)
        found[0] = 1
        found = _powers[base] = np.multiply.accumulate(found)
    return found[:n]


def prefixes(raw: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of bytes: p[i] = sum of (byte j + 1) * BASE ** j for j < i, modulo 2 ** 64."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), out=out[1:])
    return out


def substrings(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end), the same wherever they stand."""
    back = powers(INVERSE, len(prefix))
    return (prefix[end] - prefix[start]) * back[start]


_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: list[str], lower: bool = True) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order; A-Z count as a-z if lower is set."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b" ".join([b"", *raws, b""]), np.uint8)
    if lower:
        raw = _LOWER[raw]
    gap = _SPACES[raw]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    p = prefixes(raw)
    h = mix(substrings(p, start, end) + (end - start).astype(np.uint64))
    ends = np.cumsum([len(r) + 1 for r in raws])
    return np.split(h, np.searchsorted(start, ends)[:-1]) if texts else []


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n consecutive words, sorted; of all words, if there are fewer; none without words."""
    if not len(h):
        return h
    if len(h) < n:
        n = len(h)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + h[k : len(h) - n + 1 + k]
    # so that a short text isn't equal to a shingle of another size
    return np.unique(mix(out + np.uint64(n)))
