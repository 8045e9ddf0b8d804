"""Suffix array by induced sorting, and the permuted common prefixes, on numpy arrays.

Suffixes are classified from right to left as smaller (S) or larger (L) than their right neighbour; an S suffix after
an L suffix is leftmost-smaller (LMS).  LMS substrings are sorted by one pass of induction and named; the string of
names, about a third as long, gives the order of the LMS suffixes; a second pass induces all others from it.

Induction goes through the buckets of the first character one after the other.  Everything that a bucket induces is
placed at once, so a pass takes as many array steps as there are characters (and repeats of one character), and time
linear in the text.  The string of names has too large an alphabet for that; it is sorted by doubling, only where
names are not yet unique and only as far as ``depth`` characters reach.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 1


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last character must be the smallest and unique."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    rises = s[differs] < s[differs + 1]
    out = np.empty(n, dtype=bool)
    out[:-1] = np.repeat(rises, np.diff(np.concatenate([[-1], differs]))) if len(differs) else False
    out[-1] = True
    return out


def _place(sa: np.ndarray, free: np.ndarray, chars: np.ndarray, at: np.ndarray, step: int) -> None:
    """Puts the suffixes ``at`` into their buckets in the given order, from ``free`` on in direction ``step``."""
    order = np.argsort(chars, kind="stable")
    counts = np.bincount(chars, minlength=len(free))
    first = np.cumsum(counts) - counts
    sorted_chars = chars[order]
    within = np.arange(len(chars)) - first[sorted_chars]
    sa[free[sorted_chars] + step * within] = at[order]
    free += step * counts


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the LMS suffixes (by first character, otherwise in the order given)."""
    n, kinds = len(s), len(sizes)
    sa = np.full(n, -1, dtype=np.int32)
    head = np.cumsum(sizes) - sizes
    tail = np.cumsum(sizes) - 1
    ends = tail.copy()
    _place(sa, ends, s[lms[::-1]], lms[::-1], -1)
    lms_from = ends + 1
    free = head.copy()
    for c in np.flatnonzero(sizes):
        done = head[c]
        while True:  # larger suffixes of this bucket, those they induce in the same bucket included
            upto = free[c]
            if upto == done:
                break
            _larger(s, smaller, sa, free, sa[done:upto])
            done = upto
        if lms_from[c] <= tail[c]:
            _larger(s, smaller, sa, free, sa[lms_from[c]:tail[c] + 1])
    sa[_where(lms_from, tail)] = -1
    free = tail.copy()
    for c in np.flatnonzero(sizes)[::-1]:
        done = tail[c]
        while True:
            upto = free[c]
            if upto == done:
                break
            _smaller(s, smaller, sa, free, sa[upto + 1:done + 1][::-1])
            done = upto
        larger = sa[head[c]:free[c] + 1]
        _smaller(s, smaller, sa, free, larger[larger >= 0][::-1])
    sa[0] = n - 1
    return sa


def _where(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    n = np.maximum(0, last - first + 1)
    return np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _larger(s, smaller, sa, free, scan) -> None:
    before = scan[scan > 0] - 1
    before = before[~smaller[before]]
    if len(before):
        _place(sa, free, s[before], before, 1)


def _smaller(s, smaller, sa, free, scan) -> None:
    before = scan[scan > 0] - 1
    before = before[smaller[before]]
    if len(before):
        _place(sa, free, s[before], before, -1)


def _ranks(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the names, by doubling."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    sorted_names = names[order]
    new = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1]])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        at = order[open_]
        to = at + step
        second = np.where(to < n, rank[np.minimum(to, n - 1)], -1)
        key = rank[at] * (n + 1) + second + 1
        sub = np.argsort(key, kind="stable")
        at, key = at[sub], key[sub]
        order[open_] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.maximum.accumulate(np.where(first, open_, 0))  # a group keeps its places in the order
        rank[at] = start
        step *= 2
        open_ = open_[~(first & np.append(first[1:], True))]
    return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (uint8) in lexicographic order; the last character must be 0 and unique."""
    sizes = np.bincount(s)
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        sa = induce(s, smaller, lms, sizes)
        is_lms = np.zeros(len(s), dtype=bool)
        is_lms[lms] = True
        by_substring = sa[is_lms[sa]]
        lms = lms[_ranks(_names(s, lms, by_substring))]
    return induce(s, smaller, lms, sizes)


def _names(s: np.ndarray, lms: np.ndarray, sorted_lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order: equal ones (by length and characters) share one, separators do not."""
    end = np.append(lms[1:], len(s) - 1)
    length = np.zeros(len(s), dtype=np.int64)
    length[lms] = end - lms + 1
    # separators come first among the LMS suffixes (after the end of the string), in the order of their places
    apart = s[sorted_lms] == SEPARATOR
    sorted_lms = sorted_lms.copy()
    sorted_lms[apart] = np.sort(sorted_lms[apart])
    a, b = sorted_lms[:-1].astype(np.int64), sorted_lms[1:].astype(np.int64)
    same = (length[a] == length[b]) & (s[a] > SEPARATOR)
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[k < length[a[live]]]
        differ = s[a[live] + k] != s[b[live] + k]
        same[live[differ]] = False
        live = live[~differ]
        k += 1
    name = np.empty(len(s), dtype=np.int64)
    name[sorted_lms] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix in text order its common prefix with the one before it in the array.

    Only where the characters before the two suffixes differ are characters compared (eight at a time); elsewhere the
    value is one less than that of the suffix before in the text.
    """
    n = len(s)
    before = np.empty(n, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    ahead = np.concatenate([s[-1:], s[:-1]])
    start = np.flatnonzero((before >= 0) & ((before == 0) | (ahead != ahead[before]) | (ahead <= SEPARATOR)))
    common = np.zeros(n, dtype=np.int64)
    mine = np.lib.stride_tricks.sliding_window_view(np.concatenate([s, np.zeros(16, np.uint8)]), 8)
    other = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.where(s == SEPARATOR, np.uint8(255), s), np.full(16, 254, np.uint8)]), 8)
    live, k = start, 0
    while len(live):
        i, j = np.minimum(live + k, n), np.minimum(before[live] + k, n)
        x = np.ascontiguousarray(mine[i]).view(np.uint64).ravel() ^ np.ascontiguousarray(other[j]).view(np.uint64).ravel()
        equal = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        common[live] += equal
        live = live[equal == 8]
        k += 8
    reach = np.where(common > 0, common + np.arange(n), 0)
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)
