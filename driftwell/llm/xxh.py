"""XXH64 of many short byte ranges at once, in whole-array arithmetic.

The public XXH64 algorithm with its published primes; ranges are dealt by length so that each group runs the same steps.
"""

from __future__ import annotations

import numpy as np
import xxhash

# fixed values of the public algorithm
PRIMES = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
P1, P2, P3, P4, P5 = (np.uint64(p) for p in PRIMES)
#: Longer ranges, and lengths with few ranges, are hashed one by one.
LONGEST, FEW = 160, 24


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _same_length(data: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``data`` is padded by 8 bytes at least."""
    lanes8 = np.ndarray(len(data) - 7, np.dtype("<u8"), data, strides=(1,))
    lanes4 = np.ndarray(len(data) - 3, np.dtype("<u4"), data, strides=(1,))
    at, s = starts, np.uint64(seed)
    with np.errstate(over="ignore"):
        if n >= 32:
            accs = [np.full(len(starts), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            for _ in range(n // 32):
                for k in range(4):
                    accs[k] = _round(accs[k], lanes8[at + 8 * k])
                at = at + 32
            h = _rotl(accs[0], 1) + _rotl(accs[1], 7) + _rotl(accs[2], 12) + _rotl(accs[3], 18)
            for a in accs:
                h = (h ^ _round(np.zeros_like(a), a)) * P1 + P4
        else:
            h = np.full(len(starts), s + P5, np.uint64)
        h = h + np.uint64(n)
        left = n % 32
        while left >= 8:
            h = _rotl(h ^ _round(np.zeros(1, np.uint64), lanes8[at]), 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rotl(h ^ (lanes4[at].astype(np.uint64) * P1), 23) * P2 + P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h = _rotl(h ^ (data[at].astype(np.uint64) * P5), 11) * P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def xxh64_ranges(buffer: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """Unsigned XXH64 of ``buffer[s:s+n]`` for every start and length."""
    data = np.frombuffer(buffer + bytes(8), np.uint8)
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(lengths, 65535).astype(np.uint16), kind="stable")
    sizes = lengths[order]
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        if a == b:
            continue
        rows, n = order[a:b], int(sizes[a])
        if n > LONGEST or b - a < FEW:
            out[rows] = [xxhash.xxh64_intdigest(buffer[s : s + m], seed) for s, m in zip(starts[rows].tolist(), lengths[rows].tolist(), strict=True)]
        else:
            out[rows] = _same_length(data, starts[rows], n, seed)
    return out
