"""Suffix arrays by induced sorting, and common prefixes in text order.

Suffixes are classified as larger or smaller than their right neighbour, substrings between leftmost-smaller positions
are sorted and named, the string of names is sorted recursively, and the order of all suffixes is induced from it in two
linear scans (Nong, Zhang and Chan, 2009). Over small alphabets a scan handles a whole bucket at a time; over the large
alphabets of the recursion it goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned by buckets.
SMALL = 400


def places(n: int) -> type:
    """The type of places in a text of so many characters: half as wide where it will do."""
    return np.int32 if n < 1 << 31 else np.int64


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one is."""
    n = len(t)
    step = np.ones(n, np.int8)
    step[:-1] = (t[1:] > t[:-1]).view(np.int8) - (t[1:] < t[:-1]).view(np.int8)
    at = np.arange(n, dtype=places(n))
    at[step == 0] = n
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _bucket_scan(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(t), -1, places(len(t)))
    n_seeds = np.bincount(t[seeds], minlength=len(counts))
    sa[np.repeat(ends - n_seeds - (np.cumsum(n_seeds) - n_seeds), n_seeds) + np.arange(len(seeds))] = seeds
    chars = np.flatnonzero(counts)

    def place(now: np.ndarray, kind: bool, ptr: np.ndarray, sign: int) -> None:
        p = now[now > 0] - 1
        p = p[smaller[p] == kind]
        if not len(p):
            return
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        n = np.bincount(c, minlength=len(ptr))
        rank = np.arange(len(p)) - (np.cumsum(n) - n)[c]
        sa[ptr[c] + rank if sign > 0 else ptr[c] - 1 - rank] = p
        ptr += sign * n

    heads = starts.copy()
    for c in chars.tolist():
        i = starts[c]
        while i < heads[c]:
            i, now = heads[c], sa[i : heads[c]]
            place(now, False, heads, 1)
        if n_seeds[c]:
            place(sa[ends[c] - n_seeds[c] : ends[c]], False, heads, 1)
    tails = ends.copy()
    for c in chars[::-1].tolist():
        i = ends[c]
        while i > tails[c]:
            i, now = tails[c], sa[tails[c] : i][::-1]
            place(now, True, tails, -1)
        if heads[c] > starts[c]:
            place(sa[starts[c] : heads[c]][::-1], True, tails, -1)
    return sa


def _plain_scan(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    head, tail, chars, small = (ends - counts).tolist(), ends.tolist(), t.tolist(), smaller.tolist()
    sa = [0] * len(chars)
    for p in seeds[::-1].tolist():
        c = chars[p]
        tail[c] -= 1
        sa[tail[c]] = p
    for p in sa:  # grows to the right of where it is read
        if p and not small[p - 1]:
            c = chars[p - 1]
            sa[head[c]] = p - 1
            head[c] += 1
    tail = ends.tolist()
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i]
        if p and small[p - 1]:
            c = chars[p - 1]
            tail[c] -= 1
            sa[tail[c]] = p - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of the suffixes of ``t`` in order; ``t`` ends in its only 0 and stays below ``alphabet``."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    scan = _bucket_scan if alphabet <= SMALL else _plain_scan
    smaller, counts = classify(t), np.bincount(t, minlength=alphabet)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    lms = lms.astype(places(len(t)))
    mark = np.zeros(len(t), bool)
    mark[lms] = True
    sa = scan(t, smaller, lms[np.argsort(t[lms], kind="stable")], counts)
    order = sa[mark[sa]]
    del sa, mark
    # name equal substrings alike; each runs to the next leftmost-smaller position
    stop = np.zeros(len(t), places(len(t)))
    stop[lms] = np.append(lms[1:], len(t) - 1)
    a, b = order[:-1], order[1:]
    same = stop[a] - a == stop[b] - b
    live, k = np.flatnonzero(same), 0
    while len(live):
        equal = t[a[live] + k] == t[b[live] + k]
        same[live[~equal]] = False
        live, k = live[equal], k + 1
        live = live[a[live] + k <= stop[a[live]]]
    del stop, a, b
    name = np.append(0, np.cumsum(~same))
    if name[-1] + 1 < len(lms):
        names, most = np.zeros(len(t), places(len(t))), int(name[-1])
        names[order] = name
        names = names[lms]
        del name, same, live, order
        order = lms[suffix_array(names, most + 1)]
    return scan(t, smaller, order, counts)


def long_prefixes(t: np.ndarray, before: np.ndarray, starts: np.ndarray, runs: np.ndarray, most: int) -> list[np.ndarray]:
    """For offset 0, 1, … of each start while below its run: the common prefix of that suffix with the one that stands
    before it in suffix order, ``most`` at most. Along a run a prefix shrinks by one a step at most."""
    out, rows, common = [], np.arange(len(starts)), np.zeros(len(starts), np.int64)
    padded = np.append(t, np.full(most + 1, -1, t.dtype))
    for k in range(int(runs.max(initial=0))):
        keep = runs[rows] > k
        rows, common = rows[keep], np.maximum(common[keep] - 1, 0)
        i = starts[rows] + k
        j = before[i]
        live = np.flatnonzero((j >= 0) & (common < most))
        while len(live):
            live = live[padded[i[live] + common[live]] == padded[j[live] + common[live]]]
            common[live] += 1
            live = live[common[live] < most]
        common[j < 0] = 0
        out.append(common.copy())
    return out
