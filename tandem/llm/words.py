"""Words of many texts as arrays: where each one lies and a 64-bit hash of it, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of text worked on at once (a longer text is worked on alone).
CHUNK = 1 << 20


def separators(kept: bytes | None = None) -> np.ndarray:
    """Which bytes part words: the white space of the contracts, or every ASCII character outside ``kept``."""
    parts = np.zeros(256, dtype=bool)
    if kept is None:
        parts[[32, *range(9, 14)]] = True
    else:
        parts[:128] = True
        parts[np.frombuffer(kept, dtype=np.uint8)] = False
    return parts


WHITE = separators()
ALNUM = separators(b"abcdefghijklmnopqrstuvwxyz0123456789_")


def _random(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE = _random(1, 256)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, at least ``n`` of them."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 64), 0x9E3779B97F4A7C15, dtype=np.uint64)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of the texts of one chunk: byte spans in ``data``, hashes, and per text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray  # len(texts) + 1 offsets into the words


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def words_of(texts: list[bytes], parts: np.ndarray = WHITE) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    inside = ~parts[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    length = end - start
    letters = data[inside]
    first = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(first, length)
    value = BYTE[letters] * powers(int(length.max(initial=0)) + 1)[place]
    hashed = mixed(np.add.reduceat(value, first) + length.astype(np.uint64)) if len(start) else np.empty(0, np.uint64)
    text = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return Words(data, start, end, hashed, text)


def windows(h: np.ndarray, n: int, key: int = 0) -> np.ndarray:
    """Hash of ``n`` neighbouring entries from every place on; joins halves, so it takes log(n) steps."""
    m = np.uint64((0xD6E8FEB86659FD93 + 2 * key * 0x9FB21C651E98DF25) & (2**64 - 1))
    if len(h) < n:
        return np.empty(0, np.uint64)
    level, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = level, size
            else:
                k = len(h) - done - size + 1
                out = mixed(out[:k] * m + level[done:done + k])
                done += size
        if size * 2 > n:
            break
        k = len(h) - 2 * size + 1
        level = mixed(level[:k] * m + level[size:size + k])
        size *= 2
    return out[:len(h) - n + 1]


def last_start(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which places of the chunk start a window of ``n`` entries inside one text."""
    good = np.ones(total, dtype=bool)
    for k in range(1, n):
        at = offsets[1:] - k
        at = at[at >= offsets[:-1]]
        good[at] = False
    return good
