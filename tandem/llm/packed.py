"""Arrays in binary columns: byte planes, so that the shuffle's compression removes the bytes that hardly change."""

from __future__ import annotations

import numpy as np


def planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def steps(a: np.ndarray) -> np.ndarray:
    """Differences (modulo 2^64) from which ``summed`` gets the array back."""
    return np.diff(a, prepend=a.dtype.type(0))


def summed(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a, dtype=a.dtype)
