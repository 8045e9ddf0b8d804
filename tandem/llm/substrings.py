"""Substring dedup with prefix-partitioned suffix trees.

Every word of a text starts a suffix.  A first pass counts the suffixes under their prefixes of 1, 2, 4, 8 and
``window`` words; each suffix is dealt by its shortest prefix that few enough suffixes share, so frequent beginnings
are split by longer prefixes and every group fits in memory (whole windows that are still too many in one hash bucket
are split by more bits of their hash).  A group is the subtree below its prefixes: its suffixes are sorted by path,
down to the depth of a window, where every internal node is a sequence that occurs more than once.  The first suffix
below such a node stays; every other one marks its window.  Overlapping marks add up to maximal repeats.

A path is an 88-bit hash of the words along it, not the words: a suffix travels as about 12 bytes.  (At the 10^13
windows of 100 TB less than one pair of different windows is expected to agree.)  Equal windows of one batch are
merged before the shuffle: only the first of them leaves the task, the others are marked at once.  A passage that a
third of all documents share therefore reaches its group once for each batch.

Defined cases: null text: no words; texts shorter than a window lose nothing; repeated rows of a doc_id with the same
text are one document, with other texts they are told apart by the text's hash, but do not count as earlier than each
other at the same place; rows with a null doc_id keep their text and repeat nothing; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tandem.llm.packed import planes, steps, summed, unplanes
from tandem.llm.storage import parts_for, ready, stored
from tandem.llm.units import NAMES, REPEATS, ROW, SPANS, SUFFIXES, UNIT, record, spans
from tandem.llm.words import chunks, last_start, windows, words_of

#: Prefix lengths before that of the window itself, hash buckets counted for each, suffixes of a group.
PREFIXES = (1, 2, 4, 8)
BUCKET_BITS = 12
GROUP = 1_500_000


def _encoded(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def prefix_buckets(h: np.ndarray, window: int) -> list[np.ndarray]:
    """For each prefix length the bucket of every suffix that has a whole window."""
    n = len(h) - window + 1
    return [(windows(h, min(d, window))[:n] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for d in (*PREFIXES, window)]


def _prefix_counts(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(PREFIXES) + 1, 1 << BUCKET_BITS), dtype=np.int64)
        for batch in batches:
            texts = _encoded(batch.column(0).to_pylist())
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi])
                if len(w.hash) >= window:
                    good = last_start(w.text, window, len(w.hash))[:len(w.hash) - window + 1]
                    for level, bucket in enumerate(prefix_buckets(w.hash, window)):
                        counts[level] += np.bincount(bucket[good], minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["at", "n"])
    return rows


@dataclass
class Groups:
    """For each prefix length and bucket: its group, or -1 where a longer prefix decides; for whole windows also how
    many groups share the bucket."""

    group: np.ndarray
    split: np.ndarray
    count: int
    suffixes: int


def plan_groups(counts: np.ndarray, capacity: int) -> Groups:
    """Buckets that fit are laid together into groups of about the capacity; the others go on to the next length.

    Counts of longer prefixes include suffixes that a shorter one has dealt already; small buckets weigh as much of
    their count as is still open on the whole, large ones all of it.
    """
    group = np.full(counts.shape, -1, dtype=np.int64)
    split = np.ones(counts.shape[1], dtype=np.int64)
    used, open_share, total = 0, 1.0, max(1, int(counts[0].sum()))
    for level, n in enumerate(counts):
        last = level == len(counts) - 1
        fits = np.flatnonzero(n <= capacity)
        weight = np.where(n[fits] < capacity // 16, n[fits] * open_share, n[fits]).astype(np.int64)
        share = np.cumsum(weight) // capacity
        group[level, fits] = used + share
        used += int(share[-1]) + 1 if len(fits) else 0
        large = np.flatnonzero(n > capacity)
        open_share = min(open_share, int(n[large].sum()) / total)
        if last:
            split[large] = -(-n[large] // capacity)
            group[level, large] = used + np.cumsum(split[large]) - split[large]
            used += int(split[large].sum())
        elif not len(large):
            break
    return Groups(group, split, used, total)


def deal(groups: Groups, buckets: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
    """The group of every suffix; ``whole``: hash of its window."""
    out = groups.group[0][buckets[0]]
    for level in range(1, len(buckets)):
        open_ = np.flatnonzero(out < 0)
        if not len(open_):
            break
        b = buckets[level][open_]
        out[open_] = groups.group[level][b]
        if level == len(buckets) - 1:
            out[open_] += (whole[open_] & np.uint64(0xFFFFFFFF)).astype(np.int64) % groups.split[b]
    return out


def by_window(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the suffixes by window, and where a new window begins in it."""
    order = np.argsort(hi, kind="stable")
    a, b = hi[order], lo[order]
    same_hi = a[1:] == a[:-1]
    if (same_hi & (b[1:] != b[:-1])).any():
        order = np.lexsort((lo, hi))
        a, b = hi[order], lo[order]
        same_hi = a[1:] == a[:-1]
    return order, np.concatenate([[True], ~(same_hi & (b[1:] == b[:-1]))])[:len(hi)]


def _suffixes(shared, window: int):
    """The suffixes of every batch by group (the first of equal windows only), and a row about the batch itself."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        task = TaskContext.get().partitionId() << 24
        for number, batch in enumerate(batches):
            order = np.argsort(batch.column(0).to_numpy(), kind="stable")
            ids, marks = batch.column(0).to_numpy()[order], batch.column(1).to_numpy()[order]
            texts = batch.column(2).to_pylist()
            texts = _encoded([texts[i] for i in order])
            counts, base = np.zeros(len(texts), dtype=np.uint32), 0
            found: list[tuple[np.ndarray, ...]] = []
            for first, last in chunks(texts):
                w = words_of(texts[first:last])
                counts[first:last] = np.diff(w.text)
                n = len(w.hash) - window + 1
                if n > 0:
                    good = np.flatnonzero(last_start(w.text, window, len(w.hash))[:n])
                    whole = windows(w.hash, window)
                    second = (windows(w.hash, window, 1) >> np.uint64(40)).astype(np.uint32)
                    grp = deal(groups, prefix_buckets(w.hash, window), whole)
                    found.append((whole[good], second[good], (good + base).astype(np.uint32), grp[good].astype(np.int32)))
                base += len(w.hash)
            about = (planes(steps(ids)), planes(marks), planes(counts))
            unit = task + number
            if not found:
                continue
            hi, lo, at, grp = (np.concatenate(c) for c in zip(*found))
            del found
            sort, new = by_window(hi, lo)
            # the smallest (document, place) of equal windows stands first; the very same place again is no repeat
            head = np.maximum.accumulate(np.where(new, np.arange(len(sort)), 0))
            doc = np.searchsorted(np.cumsum(counts, dtype=np.int64), at[sort].astype(np.int64), side="right")
            place = at[sort].astype(np.int64) - (np.cumsum(counts, dtype=np.int64) - counts)[doc]
            again = ~new & ~((ids[doc] == ids[doc[head]]) & (place == place[head]))
            settled = np.sort(at[sort[again]])
            yield record([(unit, UNIT, unit % groups.count, b"", b"", planes(steps(settled)), b"", *about)])
            sort = sort[new]
            sort = sort[np.argsort(grp[sort], kind="stable")]
            edges = np.searchsorted(grp[sort], np.arange(groups.count + 1))
            for g in np.flatnonzero(np.diff(edges)):
                part = sort[edges[g]:edges[g + 1]]
                yield record([(unit, SUFFIXES, int(g), planes(steps(hi[part])), planes(lo[part]), planes(at[part]), b"", about[0], b"", about[2])])
    return rows


def _subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One group: nodes at window depth with several suffixes; all but the first suffix below them are repeats."""
    hi, lo, at, doc, place, unit = [], [], [], [], [], []
    units: list[int] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == UNIT:
                yield record([tuple(r[n] for n in NAMES)])
                continue
            a = unplanes(r["at"], np.uint32)
            ids, counts = summed(unplanes(r["ids"], np.int64)), unplanes(r["counts"], np.uint32)
            ends = np.cumsum(counts, dtype=np.int64)
            d = np.searchsorted(ends, a.astype(np.int64), side="right")
            hi.append(summed(unplanes(r["hi"], np.uint64)))
            lo.append(unplanes(r["lo"], np.uint32))
            at.append(a)
            doc.append(ids[d])
            place.append((a - (ends - counts)[d]).astype(np.int32))
            unit.append(np.full(len(a), len(units), dtype=np.int32))
            units.append(r["unit"])
    if not units:
        return
    hi, lo, at, doc, place, unit = (np.concatenate(c) for c in (hi, lo, at, doc, place, unit))
    sort, new = by_window(hi, lo)
    del hi, lo
    run = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(run)[run] > 1)
    sort, run = sort[several], run[several]
    order = np.lexsort((place[sort], doc[sort], run))
    sort, run = sort[order], run[order]
    if not len(sort):
        return
    head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    first = sort[np.repeat(head, np.diff(np.append(head, len(run))))]
    again = sort[(doc[sort] != doc[first]) | (place[sort] != place[first])]
    again = again[np.lexsort((at[again], unit[again]))]
    edges = np.searchsorted(unit[again], np.arange(len(units) + 1))
    for u in np.flatnonzero(np.diff(edges)):
        yield record([(units[u], REPEATS, 0, b"", b"", planes(steps(at[again[edges[u]:edges[u + 1]]])), b"", b"", b"", b"")])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, counts, removed = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2)):
            words = (text.as_py() or "").encode("utf-8").split()  # bytes.split() parts at exactly the six characters
            counts.append(len(words))
            left = words
            if gone.is_valid:
                left, at = [], 0
                for s, e in sorted(p for g in gone.as_py() for p in np.frombuffer(g, np.int32).reshape(-1, 2).tolist()):
                    left += words[at:s]
                    at = max(at, e)
                left += words[at:]
            removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


def drop_repeated_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept (the words that stay, joined by a blank)."""
    spark = docs.sparkSession
    ready(spark)
    own = docs.select(F.col(id_col).cast("long").alias("_ss_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_ss_mark"), F.col(text_col).alias("_ss_text"))
    named = own.where("_ss_id is not null")
    counted = named.select("_ss_text").mapInArrow(_prefix_counts(window), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(PREFIXES) + 1) << BUCKET_BITS, dtype=np.int64)
    counts[counted["at"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    counts = counts.reshape(len(PREFIXES) + 1, -1)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = plan_groups(counts, max(1, min(GROUP, int(counts[0].sum()) // least)))
    shared = spark.sparkContext.broadcast(groups)  # 5 x 4096 entries
    found = stored(named.mapInArrow(_suffixes(shared, window), ROW).repartitionById(groups.count, "grp")
                   .mapInArrow(_subtree, ROW).select("unit", "kind", "at", "run", "ids", "marks", "counts"), "repeats")
    by_unit = found.df.repartition(parts_for(groups.suffixes, 4 * GROUP, least), "unit").sortWithinPartitions("unit", "kind")
    gone = stored(by_unit.mapInArrow(spans(window), SPANS).groupBy("id", "mark").agg(F.collect_set("gone").alias("gone")), "spans")  # equal rows may learn of different windows
    found.drop()
    # merged at every size: spans grow with the corpus, so they are not sent to all executors while they happen to be few
    marked = gone.df.select(F.col("id").alias("_ss_id"), F.col("mark").alias("_ss_mark"), "gone").hint("merge")
    return own.join(marked, ["_ss_id", "_ss_mark"], "left").select("_ss_id", "_ss_text", "gone").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept string")


def op3(documents: DataFrame) -> DataFrame:
    return drop_repeated_passages(documents).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
