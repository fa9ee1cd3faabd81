"""Word and window hashes of many texts at once, in numpy; all arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: A value for each byte, so that sums of powers spread well.
BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
#: Bytes that are summed up at once, and the primes and bases of the second hash.
SEGMENT = 1 << 17
CHECKS = ((2147483647, 1270650317), (2147483629, 986310827))
CHECK_BYTE = np.random.default_rng(21).integers(1, 2147483629, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n at least. Tables for more than two segments are not kept."""
    if "up" in _powers and len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    size = max(n, 2 * SEGMENT)
    inverse = U(pow(int(BASE), -1, 1 << 64))
    both = []
    for b in (BASE, inverse):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p, out=p))
    if n <= 2 * SEGMENT:
        _powers["up"], _powers["down"] = both
    return both[0], both[1]


def classes(pattern: str) -> np.ndarray:
    """Table of the bytes that belong to words. 'space': all but blanks and tabs to carriage returns. 'alnum': 0-9, a-z, and bytes from 0x80."""
    t = np.zeros(256, bool)
    if pattern == "space":
        t[:] = True
        t[[32, 9, 10, 11, 12, 13]] = False
    else:
        t[48:58] = t[97:123] = t[128:] = True
    return t


def words(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; `buf` begins and ends with a byte outside of words."""
    mask = table[buf]
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return edge[0::2], edge[1::2]


def segments(starts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of ascending starts that lie within SEGMENT bytes."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts // SEGMENT)) + 1
    return list(zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(starts)).tolist(), strict=True))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end], starts ascending; works a segment at a time."""
    out = np.empty(len(starts), np.uint64)
    for x, y in segments(starts):
        low, high = int(starts[x]), int(ends[x:y].max())
        up, down = powers(high - low + 1)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(BYTE[buf[low:high]] * up[: high - low], out=sums[1:])
        a, z = starts[x:y] - low, ends[x:y] - low
        out[x:y] = mix((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64))
    return out


def check_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second hash of each buf[start:end], of another kind: polynomials modulo two primes near 2**31, whose values fill 62 bits."""
    out = np.zeros(len(starts), np.uint64)
    for x, y in segments(starts):
        low, high = int(starts[x]), int(ends[x:y].max())
        a, z = starts[x:y] - low, ends[x:y] - low
        values = CHECK_BYTE[buf[low:high]]
        for p, base in CHECKS:
            up, down = _check_powers(p, base, high - low + 1)
            sums = np.empty(high - low + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values * up[: high - low] % U(p), out=sums[1:])
            out[x:y] = (out[x:y] << U(31)) + (sums[z] - sums[a]) % U(p) * down[a] % U(p)
    return out


def _check_powers(p: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    name = f"check{p}"
    if name in _powers and len(_powers[name]) >= n:
        return _powers[name], _powers[f"-{name}"]
    both = []
    for b in (base, pow(base, -1, p)):
        # by doubling: the second half is the first times base ** its length
        powers_ = np.ones(1, np.uint64)
        while len(powers_) < max(n, 2 * SEGMENT):
            powers_ = np.concatenate([powers_, powers_ * U(pow(b, len(powers_), p)) % U(p)])
        both.append(powers_)
    if n <= 2 * SEGMENT:
        _powers[name], _powers[f"-{name}"] = both
    return both[0], both[1]


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive values; len - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= STEP
        h += hashes[j : n + j]
    return mix(h)


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k successive bytes, by doubling."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width = BYTE[buf], 1
    done, at = None, 0
    factor = int(BASE)
    while True:
        if k & width:
            if done is None:
                done = part
            else:
                m = len(part) - at
                done = done[:m] * U(pow(int(BASE), width, 1 << 64)) + part[at : at + m]
            at += width
        if width * 2 > k:
            break
        m = len(part) - width
        part = part[:m] * U(factor) + part[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    return mix(done[:n])
