"""Content-defined cutting: windows of bytes that could be equal get the same anchor.

The anchor of a window is the least hash among the ``k``-byte strings inside it (the leftmost of equal ones), so
equal windows have equal anchors at equal distances.  Neighbouring windows mostly share an anchor; such a run is
described by its first window and its length.
"""

from __future__ import annotations

import numpy as np

from tandem.llm.words import BYTE, mixed, powers

#: Longest piece of a text that is worked on at once; pieces overlap by a window less one.
PIECE = 1 << 22
_PLACE = np.uint64((1 << 23) - 1)
_BASE = 0x9E3779B97F4A7C15
_inverse = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        base = np.full(max(n, 64), pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        base[0] = 1
        _inverse = np.cumprod(base, dtype=np.uint64)
    return _inverse


def string_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` bytes from every place on."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(len(data) + 1)[:len(data)], dtype=np.uint64)])
    return mixed((upto[k:] - upto[:-k]) * inverse_powers(len(data) + 1)[:len(data) - k + 1])


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours: prefix and suffix minima of blocks of ``w``."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in the texts that lie at [starts, ends): anchor hash, first window, windows, and
    where the anchor lies."""
    if len(data) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = string_hashes(data, k)
    key = sliding_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), window - k + 1)
    change = np.zeros(len(key) + 1, dtype=np.int8)
    long_ = ends - starts >= window
    np.add.at(change, starts[long_], 1)
    np.add.at(change, ends[long_] - window + 1, -1)
    good = np.cumsum(change[:-1]) > 0
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(good & (new | np.concatenate([[True], ~good[:-1]])))
    stop = np.flatnonzero(good & (np.append(new[1:], True) | np.append(~good[1:], True))) + 1
    place = (key[first] & _PLACE).astype(np.int64)
    return h[place], first, stop - first, place


def shorter_runs(first: np.ndarray, n: np.ndarray, place: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Cuts runs where the distance to the anchor passes a multiple of ``step``: run cut, first window, windows, and the
    place from which on all windows at such distances share ``window - step + 1`` bytes."""
    nearest, farthest = (place - first - n + 1) // step, (place - first) // step
    pieces = farthest - nearest + 1
    run = np.repeat(np.arange(len(first)), pieces)
    level = farthest[run] - (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    begin = np.maximum(first[run], place[run] - level * step - step + 1)
    end = np.minimum(first[run] + n[run], place[run] - level * step + 1)
    return run, begin, end - begin, place[run] - level * step
