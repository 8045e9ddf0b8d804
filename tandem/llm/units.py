"""Batches of documents as units of exchange.

Operators that look for repeats send places, not texts.  A place is an index into the words (or bytes) of a batch,
its unit; one row about the unit says which documents these are (``ids``, a hash of each text in ``marks``, and how
many words each has in ``counts``).  Groups answer with places, and the unit turns them into spans of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tandem.llm.packed import summed, unplanes

#: Kinds of rows, in the order in which a unit needs them.
SUFFIXES, UNIT, REPEATS, SHIPPED = 0, 1, 2, 3
ROW = "unit long, kind int, grp int, hi binary, lo binary, at binary, run binary, ids binary, marks binary, counts binary"
NAMES = ["unit", "kind", "grp", "hi", "lo", "at", "run", "ids", "marks", "counts"]
SPANS = "id long, mark long, gone binary"


def record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=NAMES)


def covered_spans(starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document, [start, end, ...] in its own places) from spans [start, end) of the unit that lie inside documents."""
    total = int(counts.sum())
    inside = np.cumsum(np.bincount(starts, minlength=total + 1) - np.bincount(ends, minlength=total + 1))[:total] > 0
    begin = np.cumsum(counts) - counts
    fresh = np.zeros(total + 1, dtype=bool)
    fresh[begin[counts > 0]] = True
    fresh[total] = True
    first = np.flatnonzero(inside & (~np.concatenate([[False], inside[:-1]]) | fresh[:total]))
    last = np.flatnonzero(inside & (~np.concatenate([inside[1:], [False]]) | fresh[1:])) + 1
    doc = np.searchsorted(np.cumsum(counts), first, side="right")
    for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
        if len(part):
            d = int(doc[part[0]])
            yield d, np.stack([first[part] - begin[d], last[part] - begin[d]], axis=1).astype(np.int32).ravel()


def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """From rows sorted by unit and kind: the row about the unit, and all its rows."""
    about, held = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if about is not None and r["unit"] != about["unit"]:
                yield about, held
                about, held = None, []
            if r["kind"] == UNIT:
                about = r
            held.append(r)
    if about is not None:
        yield about, held


def identity(about: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks and counts of a unit's documents."""
    return (summed(unplanes(about["ids"], np.int64)), unplanes(about["marks"], np.int64), unplanes(about["counts"], np.uint32).astype(np.int64))


def spans(window: int):
    """Spans of every document that loses something; a row's ``run`` (empty: ones) says how many windows start in a row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for about, held in by_unit(batches):
            ids, marks, counts = identity(about)
            starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for r in held:
                at = summed(unplanes(r["at"], np.uint32)).astype(np.int64)
                starts.append(at)
                ends.append(at + window + (unplanes(r["run"], np.uint16).astype(np.int64) - 1 if r["run"] else 0))
            got = list(covered_spans(np.concatenate(starts), np.concatenate(ends), counts))
            docs = [d for d, _ in got]
            yield pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(marks[docs]), pa.array([s.tobytes() for _, s in got], pa.binary())],
                                             names=["id", "mark", "gone"])
    return rows
