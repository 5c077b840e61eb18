"""Vectorised hashing of words and word windows, on NumPy arrays.

All arithmetic is modulo 2**64. A window's value is a polynomial over the hashes of its words,
from prefix sums, so that a window of any length costs the same. XXH64 hashes byte strings.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


WINDOW_BASES = (_splitmix(2) | 1, _splitmix(3) | 1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + U(_splitmix(seed))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, dtype=U)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 1 << 64))
            done += step
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def _ranges(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials over values[start:end], alike for alike values wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(values * powers(pow(base, -1, 1 << 64), n + 1)[:n], out=total[1:])
    return (total[ends] - total[starts]) * powers(base, n + 1)[starts]


def windows(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """One 64-bit value per window of `length` words; windows across documents included."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    at = np.arange(n)
    return mix(_ranges(mix(words, 10 + which), WINDOW_BASES[which], at, at + length), 20 + which)


# The primes of XXH64.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(buf: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer, ranges of one length at a time."""
    out = np.empty(len(starts), dtype=U)
    padded = buf + bytes(8)
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray((len(buf) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    one = np.frombuffer(padded, dtype=np.uint8)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    for n, rows in zip(sizes.tolist(), np.split(order, first[1:]), strict=True):
        at = starts[rows].copy()
        left = n
        if n >= 32:
            acc = [np.full(len(at), (seed + v) & MASK, dtype=U) for v in (int(P1) + int(P2), int(P2), 0, -int(P1))]
            while left >= 32:
                for k in range(4):
                    acc[k] = _rot(acc[k] + eight[at + 8 * k] * P2, 31) * P1
                at += 32
                left -= 32
            h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for k in range(4):
                h = (h ^ (_rot(acc[k] * P2, 31) * P1)) * P1 + P4
        else:
            h = np.full(len(at), (seed + int(P5)) & MASK, dtype=U)
        h += U(n)
        while left >= 8:
            h = _rot(h ^ (_rot(eight[at] * P2, 31) * P1), 27) * P1 + P4
            at += 8
            left -= 8
        if left >= 4:
            h = _rot(h ^ (four[at].astype(U) * P1), 23) * P2 + P3
            at += 4
            left -= 4
        while left:
            h = _rot(h ^ (one[at].astype(U) * P5), 11) * P1
            at += 1
            left -= 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
        out[rows] = h
    return out
