"""Outcomes of option structures over a grid of spots, on Arrow batches.

A row is one structure with all its legs.  Its grid arises, is valued and added up inside the batch, a few structures at a
time, and leaves as rows or as its summary; no grid point is moved between tasks or waits for another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from tandem.functions.american import american, european

#: Values worked on at once, so that they stay in a core's cache.
AT_ONCE = 1 << 15
TIME_FLOOR = 0.01
PROFIT = 1e-9
SUMMARY = "points long, best double, worst double, mean double, gains double, last_gain double, first_gain double"
#: A grid's points of some structures: spots, outcomes, and where these are not null; structures x steps x points each.
Grid = tuple[np.ndarray, np.ndarray, np.ndarray]


class Legs:
    """Legs of some structures by column: values with NaN for null, where they are not null, and where structures begin."""

    def __init__(self, structs: pa.StructArray, begin: np.ndarray):
        self.begin = begin
        self.call = np.array([k == "c" for k in structs.field("option_type").to_pylist()], dtype=bool)
        self.value, self.known = {}, {}
        for k, f in enumerate(structs.type):
            if f.name != "option_type":
                c = structs.field(k)
                self.known[f.name] = ~c.is_null().to_numpy(zero_copy_only=False)
                self.value[f.name] = c.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)

    def all_known(self, names: Sequence[str]) -> np.ndarray:
        return np.logical_and.reduce([self.known[n] for n in names])

    def added(self, gain: np.ndarray, known: np.ndarray, spot: np.ndarray) -> Grid:
        """Sum of the known gains and least spot of each structure, as SQL's sum and min take nulls."""
        known = np.broadcast_to(known, gain.shape)
        total = np.add.reduceat(np.where(known, gain, 0.0), self.begin, axis=0)
        least = np.fmin.reduceat(spot, self.begin, axis=0)
        return np.broadcast_to(least, total.shape), total, np.logical_or.reduceat(known, self.begin, axis=0)


def scenario_values(width: float, points: int, fractions: int, exercise: bool) -> Callable[[Legs], Grid]:
    def values(legs: Legs) -> Grid:
        col = lambda n: legs.value[n][:, None, None]
        side = np.where(legs.call, 1.0, -1.0)[:, None, None]
        spot = col("fs") * (1 - width + 2 * width * np.arange(points) / (points - 1))
        left = np.fmax(col("t") * (1 - np.arange(1, fractions + 1) / float(fractions))[:, None], TIME_FLOOR)
        x, r, v = col("x"), col("r"), col("v")
        b = r - col("q")
        with np.errstate(all="ignore"):
            if exercise:
                start, value = american(side > 0, col("fs"), x, col("t"), r, b, v), american(side > 0, spot, x, left, r, b, v)
            else:
                start, value = col("_v0"), european(side, spot, x, left, r, b, v)
            gain = col("sign") * (value - start) + col("kept") * start + col("stock") * (spot - col("fs"))
        known = legs.all_known([n for n in legs.known if n != "v"])[:, None, None]  # in SQL too, no volatility gives the value 0
        return legs.added(gain, known & ~np.isnan(gain) if exercise else known, spot)
    return values


def payoff_values(points: int) -> Callable[[Legs], Grid]:
    def values(legs: Legs) -> Grid:
        col = lambda n: legs.value[n][:, None, None]
        spot = col("_low") + (col("_high") - col("_low")) * np.arange(points) / (points - 1)
        inside = np.where(legs.call[:, None, None], spot - col("x"), col("x") - spot)
        with np.errstate(all="ignore"):
            own = np.where(inside < 0, -col("premium"), inside * col("delta") - col("premium"))
            gain = col("sign") * own * col("scale") + col("stock") * (spot - col("fs"))
        whole = legs.all_known([n for n in legs.known if n != "delta"])[:, None, None]
        return legs.added(gain, whole & ((inside < 0) | legs.known["delta"][:, None, None]), spot)
    return values


def _nulls(values: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(values.ravel(), mask=~known.ravel())


def _summary(spot: np.ndarray, value: np.ndarray, known: np.ndarray) -> list[pa.Array]:
    """Count, greatest, least, mean, share of profits and the last and first spot with one; NaN counts as the greatest number."""
    n = known.sum(axis=2)
    best = np.where(known, value, -np.inf).max(axis=2)
    worst = np.fmin.reduce(np.where(known, value, np.nan), axis=2)
    with np.errstate(all="ignore"):
        mean = np.where(known, value, 0.0).sum(axis=2) / n
    gain = known & ((value > PROFIT) | np.isnan(value))
    last, first = np.where(gain, spot, -np.inf).max(axis=2), np.where(gain, spot, np.inf).min(axis=2)
    some, won = n > 0, gain.any(axis=2)
    every = np.ones(n.shape, bool)
    return [pa.array(np.full(n.size, value.shape[2], np.int64)), _nulls(best, some), _nulls(worst, some), _nulls(mean, some),
            _nulls(gain.mean(axis=2), every), _nulls(last, won), _nulls(first, won)]


def told(keys: Sequence[str], values: Callable[[Legs], Grid], size: int, steps: bool, summed: bool, names: Sequence[str]):
    """Reads (keys, legs); ``size`` grid points a leg, ``steps``: the step is a column, ``summed``: the summary of each grid."""
    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(len(keys))
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        spot, value, known = values(Legs(lists.flatten(), np.concatenate([[0], ends[:-1]])))
        n, f, p = value.shape
        row, step, point = np.indices((n, f, 1 if summed else p)).reshape(3, -1)
        out = [batch.column(k).take(pa.array(row)) for k in range(len(keys))]
        if steps:
            out.append(pa.array((step + 1).astype(np.int32)))
        if summed:
            out += _summary(spot, value, known)
        else:
            out += [pa.array(point.astype(np.int32)), _nulls(spot, ~np.isnan(spot)), _nulls(value, known)]
        return pa.RecordBatch.from_arrays(out, names=list(names))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(len(keys)).value_lengths().to_numpy(zero_copy_only=False)
            block = np.cumsum(lengths) * size // AT_ONCE
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(lengths)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield chunk(batch.slice(lo, hi - lo))
    return rows
