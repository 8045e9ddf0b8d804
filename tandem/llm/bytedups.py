"""Suffix-array dedup of byte strings by induced sorting.

A byte goes when a string of ``window`` bytes that covers it also starts anywhere else in the corpus.  A suffix array of
everything would take many times the corpus; only places that can matter get one:

0. Windows are cut into runs by anchors (``anchors``): equal windows have equal anchors.  Anchors are counted.
1. Runs travel as hashes.  Runs of an anchor with over ``HOT`` of them are cut into pieces of ``PIECES`` windows at
   fixed distances from it, and what all windows at these distances share becomes the anchor of the piece; so an
   anchor in any number of documents spreads over many groups, as far as its surroundings differ.
   A run whose whole context (all bytes of its windows) occurs twice is settled; an anchor with one context is done.
2. One copy of every context whose anchor has several contexts is sent to a group chosen by the anchor.
3. A group concatenates its contexts to one shard, builds the shard's suffix array by induced sorting and the
   permuted common prefixes.  A window is repeated if its common prefix with a neighbour in the array is as long.

Settled and repeated windows are joined as spans with the texts.

Defined cases: null text: empty; texts shorter than the window lose nothing; repeated rows of a doc_id are texts of
their own, so both lose what they share (any other start counts); rows with a null doc_id keep their text and count as
no other start; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tandem.llm.anchors import PIECE, runs, shorter_runs
from tandem.llm.leaks import has, places, seed_filter
from tandem.llm.packed import planes, steps, summed, unplanes
from tandem.llm.storage import parts_for, ready, stored
from tandem.llm.suffixarray import permuted_prefixes, suffix_array
from tandem.llm.units import NAMES, REPEATS, ROW, SHIPPED, SPANS, SUFFIXES, UNIT, by_unit, identity, record, spans
from tandem.llm.words import chunks, mixed

#: Bytes of an anchor, runs that make it hot and windows of the pieces then, runs of a group of step 1, context bytes of a shard of step 3.
ANCHOR = 128
HOT = 4000
PIECES = 16
GROUP_RUNS = 1_000_000
SHARD = 2_000_000
DOC_RUNS = np.dtype([("at", "<i4"), ("run", "<u2"), ("settled", "u1"), ("v", "<u8")])


def _encoded(texts) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def _pieces(texts: list[bytes], window: int) -> tuple[list[bytes], np.ndarray]:
    """Long texts in overlapping pieces, each window in one of them; where each piece starts in the unit."""
    out, base, at = [], [], 0
    for t in texts:
        for s in range(0, max(1, len(t) - window + 1), PIECE):
            out.append(t[s:s + PIECE + window - 1])
            base.append(at + s)
        at += len(t)
    return out, np.array(base, dtype=np.int64)


def _anchor_runs(texts: list[bytes], window: int) -> Iterator[tuple[bytes, np.ndarray, tuple[np.ndarray, ...]]]:
    """Of each chunk: its bytes, what to add to a place to get that in the batch (per run), and its runs."""
    parts, base = _pieces(texts, window)
    for lo, hi in chunks(parts):
        size = np.fromiter(map(len, parts[lo:hi]), dtype=np.int64, count=hi - lo)
        ends = np.cumsum(size)
        joined = b"".join(parts[lo:hi])
        found = runs(np.frombuffer(joined, np.uint8), ends - size, ends, window, ANCHOR)
        if len(found[0]):
            yield joined, (base[lo:hi] - ends + size)[np.searchsorted(ends, found[1], side="right")], found


def _anchor_counts(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r[0] for _, _, r in _anchor_runs(_encoded(batch.column(0).to_pylist()), window)]
            if found:
                v, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], names=["seed", "n"])
    return rows


def _runs(shared, groups: int, window: int):
    """Every run of a batch by group; equal contexts of a batch are merged and settled at once."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, hot_table = TaskContext.get().partitionId() << 24, shared.value
        for number, batch in enumerate(batches):
            texts = _encoded(batch.column(2).to_pylist())
            counts = np.fromiter(map(len, texts), dtype=np.uint32, count=len(texts))
            found = []
            for joined, shift, (v, first, n, place) in _anchor_runs(texts, window):
                one, two = places(v)
                hot = has(hot_table, one) & has(hot_table, two)
                if hot.any():
                    run, begin, short, share = shorter_runs(first[hot], n[hot], place[hot], PIECES)
                    anchor = contexts_hash(joined, share, np.full(len(share), window - PIECES + 1)) + (place[hot][run] - share).astype(np.uint64)
                    v, first, n = (np.concatenate([x[~hot], y]) for x, y in ((v, anchor), (first, begin), (n, short)))
                    shift = np.concatenate([shift[~hot], shift[hot][run]])
                found.append((v, contexts_hash(joined, first, n + window - 1), (first + shift).astype(np.uint32), n.astype(np.uint16)))
            if not found:
                continue
            v, context, at, n = (np.concatenate(c) for c in zip(*found))
            unit = task + number
            order = np.lexsort((at, context, v))
            v, context, at, n = v[order], context[order], at[order], n[order]
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (context[1:] != context[:-1])])
            copies = np.diff(np.append(np.flatnonzero(new), len(v)))
            many = np.repeat(copies > 1, copies)
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield record([(unit, UNIT, unit % groups, b"", b"", *_places(at[many], n[many]), planes(steps(ids)), planes(marks), planes(counts))])
            v, context, at, n, many = v[new], context[new], at[new], n[new], many[new].astype(np.uint8)
            grp = ((v >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(grp, kind="stable")
            edges = np.searchsorted(grp[order], np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(edges)):
                p = order[edges[g]:edges[g + 1]]
                yield record([(unit, SUFFIXES, int(g), planes(steps(v[p])), planes(context[p]), planes(at[p]), planes(n[p]), planes(many[p]), b"", b"")])
    return rows


def contexts_hash(data: bytes, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), (first + length).tolist())), dtype=np.uint64, count=len(first))


def _places(at: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    order = np.argsort(at, kind="stable")
    return planes(steps(at[order])), planes(n[order])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 in one group: contexts that occur twice, and one copy of those whose anchor has several contexts."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    units: list[int] = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"] == UNIT:
                yield record([tuple(r[n] for n in NAMES)])
                continue
            at = unplanes(r["at"], np.uint32)
            for col, x in zip(cols, (summed(unplanes(r["hi"], np.uint64)), unplanes(r["lo"], np.uint64), at, unplanes(r["run"], np.uint16),
                                     unplanes(r["ids"], np.uint8), np.full(len(at), len(units), np.int32))):
                col.append(x)
            units.append(r["unit"])
    if not units:
        return
    v, context, at, n, many, unit = (np.concatenate(c) for c in cols)
    order = np.lexsort((context, v))
    v, context, at, n, many, unit = v[order], context[order], at[order], n[order], many[order], unit[order]
    new_v = np.concatenate([[True], v[1:] != v[:-1]])
    new = new_v | np.concatenate([[True], context[1:] != context[:-1]])
    copies = np.diff(np.append(np.flatnonzero(new), len(v)))
    twice = np.repeat(copies > 1, copies)
    several = np.bincount(np.cumsum(new_v) - 1, weights=new)[np.cumsum(new_v) - 1] > 1
    settled = np.repeat((copies > 1) | (np.maximum.reduceat(many, np.flatnonzero(new)) > 0), copies)
    for kind, mask in ((REPEATS, twice), (SHIPPED, new & several)):
        own = np.flatnonzero(mask)
        own = own[np.lexsort((at[own], unit[own]))]
        edges = np.searchsorted(unit[own], np.arange(len(units) + 1))
        for u in np.flatnonzero(np.diff(edges)):
            p = own[edges[u]:edges[u + 1]]
            rest = (planes(v[p]), planes(settled[p].astype(np.uint8))) if kind == SHIPPED else (b"", b"")
            yield record([(units[u], kind, 0, *rest, planes(steps(at[p])), planes(n[p]), b"", b"", b"")])


def _shipped(window: int):
    """Per document the runs whose contexts are sent, and their bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for about, held in by_unit(batches):
            ids, marks, counts = identity(about)
            parts = []
            for r in held:
                if r["kind"] == SHIPPED:
                    at = summed(unplanes(r["at"], np.uint32))
                    x = np.empty(len(at), DOC_RUNS)
                    x["at"], x["run"], x["settled"], x["v"] = at, unplanes(r["run"], np.uint16), unplanes(r["lo"], np.uint8), unplanes(r["hi"], np.uint64)
                    parts.append(x)
            if not parts:
                continue
            x = np.concatenate(parts)
            x = x[np.argsort(x["at"], kind="stable")]
            ends = np.cumsum(counts)
            doc = np.searchsorted(ends, x["at"].astype(np.int64), side="right")
            x["at"] = x["at"] - (ends - counts)[doc]
            edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-2))
            got = [(int(doc[a]), x[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[[d for d, _ in got]]), pa.array(marks[[d for d, _ in got]]), pa.array([y.tobytes() for _, y in got], pa.binary()),
                 pa.array([int(y["run"].sum()) + len(y) * (window - 1) for _, y in got], pa.int64())], names=["id", "mark", "runs", "size"])
    return rows


def _contexts(groups: int, window: int):
    """The bytes of the contexts by shard; ``marks`` holds them, ``ids`` whether they are settled already."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (1 << 62) + (TaskContext.get().partitionId() << 24)
        for number, batch in enumerate(batches):
            texts = _encoded(batch.column(2).to_pylist())
            counts = np.fromiter(map(len, texts), dtype=np.uint32, count=len(texts))
            begin = np.cumsum(counts, dtype=np.int64) - counts
            all_runs = []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                x = np.concatenate([np.frombuffer(r, DOC_RUNS) for r in raw])
                x = x[np.argsort(x["at"], kind="stable")]
                x["at"] += begin[i]
                all_runs.append(x)
            if not all_runs:
                continue
            x = np.concatenate(all_runs)
            unit = task + number
            yield record([(unit, UNIT, unit % groups, b"", b"", b"", b"", planes(steps(batch.column(0).to_numpy())), planes(batch.column(1).to_numpy()), planes(counts))])
            data = b"".join(texts)
            grp = (mixed(x["v"]) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(grp, kind="stable")
            edges = np.searchsorted(grp[order], np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(edges)):
                y = x[order[edges[g]:edges[g + 1]]]
                body = b"".join([data[a:b] for a, b in zip(y["at"].tolist(), (y["at"] + y["run"].astype(np.int64) + window - 1).tolist())])
                yield record([(unit, SUFFIXES, int(g), b"", b"", planes(y["at"].astype(np.uint32)), planes(y["run"]), planes(y["settled"]), body, b"")])
    return rows


def repeated_windows(bodies: list[bytes], window: int) -> np.ndarray:
    """For each byte of the joined contexts (a separator after each): does a window of the same bytes start elsewhere?

    UTF-8 has no byte above 0xF4, so text bytes move up by two; 1 separates contexts and 0 ends the string.
    """
    body = np.frombuffer(b"".join(bodies), np.uint8) + np.uint8(2)
    size = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    s = np.ones(len(body) + len(bodies) + 1, dtype=np.uint8)
    s[np.arange(len(body)) + np.repeat(np.arange(len(bodies)), size)] = body
    s[-1] = 0
    sa = suffix_array(s)
    common = permuted_prefixes(s, sa)
    out = common >= window
    out[sa[:-1]] |= common[sa[1:]] >= window
    return out


def _shard(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: list[bytes] = []
        at, n, settled, unit, units = [], [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == UNIT:
                    yield record([tuple(r[x] for x in NAMES)])
                    continue
                run = unplanes(r["run"], np.uint16).astype(np.int64)
                ends = np.cumsum(run + window - 1)
                bodies += [r["marks"][a:b] for a, b in zip((ends - run - window + 1).tolist(), ends.tolist())]
                at.append(unplanes(r["at"], np.uint32).astype(np.int64))
                n.append(run)
                settled.append(unplanes(r["ids"], np.uint8) > 0)
                unit.append(np.full(len(run), len(units)))
                units.append(r["unit"])
        if not units:
            return
        at, n, settled, unit = (np.concatenate(c) for c in (at, n, settled, unit))
        again = repeated_windows(bodies, window)
        first = np.cumsum(n + window) - n - window
        inside = np.zeros(len(again), dtype=bool)
        where = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        inside[where[~np.repeat(settled, n)]] = True
        again &= inside  # windows lie inside their context, so equal neighbours never join two contexts
        edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0))
        begin, stop = edge[::2], edge[1::2]
        own = np.searchsorted(first, begin, side="right") - 1
        place, run, whose = (at[own] + begin - first[own]).astype(np.uint32), (stop - begin).astype(np.uint16), unit[own]
        order = np.lexsort((place, whose))
        edges = np.searchsorted(whose[order], np.arange(len(units) + 1))
        for u in np.flatnonzero(np.diff(edges)):
            p = order[edges[u]:edges[u + 1]]
            yield record([(units[u], REPEATS, 0, b"", b"", planes(steps(place[p])), planes(run[p]), b"", b"", b"")])
    return rows


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(4)]
        for text, gone in zip(batch.column(1), batch.column(2)):
            data = (text.as_py() or "").encode("utf-8", "replace")
            kept, at, spans_n = [], 0, 0
            pairs = sorted(p for g in (gone.as_py() or []) for p in np.frombuffer(g, np.int32).reshape(-1, 2).tolist())
            last = -1
            for s, e in pairs:
                if s > last:
                    spans_n += 1
                    kept.append(data[at:s])
                last = max(last, e)
                at = last
            kept.append(data[at:])
            left = b"".join(kept)
            for col, x in zip(cols, (len(data), len(data) - len(left), spans_n, left)):
                col.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeated_bytes(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    spark = docs.sparkSession
    ready(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    named = own.where("id is not null")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = named.select("text").mapInArrow(_anchor_counts(window), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    hot = stored(counted.where(F.col("n") > HOT).select("seed"), "hot")
    shared = spark.sparkContext.broadcast(seed_filter(hot.df))  # of fixed size
    hot.drop()
    groups = parts_for(size * 2 / (window - ANCHOR + 1), GROUP_RUNS, least)
    settled = stored(named.mapInArrow(_runs(shared, groups, window), ROW).repartitionById(groups, "grp").mapInArrow(_settle, ROW).drop("grp"), "settled")
    units = settled.df.repartition(parts_for(size, 64e6, least), "unit").sortWithinPartitions("unit", "kind")
    # equal rows in several units: each context is sent from one of them, so their runs belong together
    shipped = stored(units.mapInArrow(_shipped(window), "id long, mark long, runs binary, size long").groupBy("id", "mark").agg(
        F.collect_list("runs").alias("runs"), F.sum("size").alias("size")), "shipped")
    shards = parts_for(shipped.df.agg(F.sum("size")).first()[0] or 0, SHARD, least)
    # merged at every size: what is joined grows with the corpus
    sent = named.join(shipped.df.hint("merge"), ["id", "mark"]).select("id", "mark", "text", "runs")
    repeats = stored(sent.mapInArrow(_contexts(shards, window), ROW).repartitionById(shards, "grp").mapInArrow(_shard(window), ROW).drop("grp"), "repeats")
    shipped.drop()
    both = settled.df.where(F.col("kind") != SHIPPED).unionByName(repeats.df)
    places = both.repartition(parts_for(size, 64e6, least), "unit").sortWithinPartitions("unit", "kind")
    gone = stored(places.mapInArrow(spans(window), SPANS).groupBy("id", "mark").agg(F.collect_set("gone").alias("gone")), "spans")
    settled.drop()
    repeats.drop()
    return own.join(gone.df.hint("merge"), ["id", "mark"], "left").select("id", "text", "gone").mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9(documents: DataFrame) -> DataFrame:
    return drop_repeated_bytes(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
