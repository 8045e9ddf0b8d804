"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over ``SPAN`` neighbouring words; only the words under its ones are hashed, so a substituted
word under a zero does not hide a match.  Seeds of the benchmark become a table; a Bloom filter of fixed size made
from it tells tasks which seeds of the documents can occur there at all.  Those hits leave the scan, with the words
around them, and are joined with the benchmark's seeds; each hit fixes an alignment (document place minus item
place), along which the longest stretch with at least ``identity`` equal words, between two equal ones, is verified.

A stretch counts when it has ``min_words`` words, or ``min_words`` exceeds the item and it covers ``identity`` of it.

Words are runs of letters, digits and ``_`` of the lower-cased text (bytes above ASCII count as letters).  Defined
cases: null or empty texts match nothing, items shorter than the span only where they stand whole; repeated rows of a document or item give
one row; ties between alignments go to the earlier place in the document, then in the item; null ids are left out;
an empty table on either side gives an empty result.

Scale: the scan keeps 2^``FILTER_BITS`` bits and one chunk of text; only hits are shuffled.  A seed that is frequent in
the documents meets only the items that hold it; equal alignments are merged before the texts are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandem.llm.storage import ready, stored
from tandem.llm.words import ALNUM, chunks, last_start, mixed, words_of

#: Fixed masks: 1 = compared, 0 = any word.
#: Together they hit every stretch of 10 to 25 words in which at most every fifth word on average differs, and so every
#: longer one: cut into pieces of 13 to 25 words, it has one that is as much alike as the whole.
MASKS = ("1100101011", "1011011001", "0111000111", "0010111110", "1101110100", "1111010010", "0001011111", "0011101101", "1010010111",
         "0110111001", "0011101110")
SPAN = len(MASKS[0])
FILTER_BITS = 26
AROUND = 64


def seeds(h: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the words under the ones of a mask, from every place on."""
    n = len(h) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, mask + 1, dtype=np.uint64)
    for k, one in enumerate(MASKS[mask]):
        if one == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
    return mixed(out)


def whole_seeds(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of ``n`` neighbouring words, from every place on: seeds of items shorter than the span."""
    out = np.full(max(0, len(h) - n + 1), len(MASKS) + n, dtype=np.uint64)
    for k in range(n if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(out)]
    return mixed(out)


def _encoded(texts) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), _encoded(batch.column(1).to_pylist())):
            h = words_of([text], ALNUM).hash
            if not len(h):
                continue
            all_seeds = [seeds(h, m) for m in range(len(MASKS))] if len(h) >= SPAN else [whole_seeds(h, len(h))]
            n = len(all_seeds[0])
            rows = n * len(all_seeds)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * rows, pa.int64()), pa.array(np.concatenate(all_seeds).view(np.int64)),
                 pa.array(np.tile(np.arange(n, dtype=np.int32), len(all_seeds))), pa.array(np.full(rows, min(len(h), SPAN), np.int32))],
                names=["item_id", "seed", "at", "span"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words_of([t], ALNUM).hash.tobytes() for t in _encoded(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.binary())], names=["item_id", "item_words"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seed = batch.column(0).to_numpy().view(np.uint64)
        for at in places(seed):
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.int64(1) << (at & 63)))], names=["word", "bits"])


def places(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.uint64((1 << FILTER_BITS) - 1)
    return (seed & cut).astype(np.int64), (seed >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def seed_filter(item_seeds: DataFrame) -> np.ndarray:
    """The Bloom filter: 2^FILTER_BITS bits whatever the benchmark's size."""
    got = (item_seeds.select("seed").mapInArrow(_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    table[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return table


def has(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 6] >> (at & 63)) & 1 == 1


HITS = "doc_id long, region long, first int, words binary, hits array<struct<seed:long,at:int>>"


def _scan(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, spans = shared.value
        kind = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _encoded(batch.column(1).to_pylist())
            out: list[tuple] = []
            for lo, hi in chunks(texts):
                w = words_of(texts[lo:hi], ALNUM)
                at, seed = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for span in spans:
                    if len(w.hash) < span:
                        continue
                    good = last_start(w.text, span, len(w.hash))[:len(w.hash) - span + 1]
                    for s in (seeds(w.hash, m) for m in range(len(MASKS))) if span == SPAN else (whole_seeds(w.hash, span),):
                        one, two = places(s)
                        hit = np.flatnonzero(has(table, one) & good)
                        hit = hit[has(table, two[hit])]
                        at.append(hit)
                        seed.append(s[hit])
                at, seed = np.concatenate(at), np.concatenate(seed)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order].view(np.int64)
                doc = np.searchsorted(w.text, at, side="right") - 1
                cuts = np.flatnonzero((np.diff(at) > AROUND) | (np.diff(doc) > 0)) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    d = doc[part[0]]
                    base = w.text[d]
                    begin = max(base, at[part[0]] - AROUND)
                    stop = min(w.text[d + 1], at[part[-1]] + SPAN + AROUND)
                    out.append((ids[lo + d], int(at[part[0]] - base), int(begin - base), w.hash[begin:stop].tobytes(),
                                [{"seed": int(s), "at": int(a - base)} for s, a in zip(seed[part], at[part])]))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                     pa.array(cols[3], pa.binary()), pa.array(cols[4], kind)], names=["doc_id", "region", "first", "words", "hits"])
    return rows


def best_stretch(same: np.ndarray, identity: float) -> tuple[int, int]:
    """The longest stretch [a, b) that begins and ends with equal words and has at least ``identity`` of them; of equals the first."""
    gain = np.concatenate([[0.0], np.cumsum(same - identity)])
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0
    at_end = np.full(len(gain), -np.inf)
    at_end[starts + 1] = gain[starts + 1]
    later = np.maximum.accumulate(at_end[::-1])  # falls with the place, so it rises from the end
    ends = len(gain) - 1 - np.searchsorted(later, gain[starts] - 1e-9)
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k])


def _verify(identity: float, min_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for r in batch.to_pylist():
                doc, item = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
                shift = r["first"] - r["shift"]  # item place of the region's first word
                a, b = max(0, -shift), min(len(doc), len(item) - shift)
                same = doc[a:b] == item[a + shift:b + shift]
                s, e = best_stretch(same, identity)
                need = min_words if len(item) >= min_words else identity * len(item)
                if e - s >= need:
                    for col, v in zip(cols, (r["doc_id"], r["item_id"], e - s, int(same[s:e].sum()), r["first"] + a + s, a + s + shift)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "item_id", "n_words", "n_equal", "doc_start", "item_start"])
    return rows


def find_leaks(docs: DataFrame, benchmark: DataFrame, identity: float = 0.8, min_words: int = 13, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that share a passage: its best stretch."""
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    item_seeds = stored(items.mapInArrow(_item_seeds, "item_id long, seed long, at int, span int").distinct(), "seeds")
    spans = [r["span"] for r in item_seeds.df.select("span").distinct().collect()]  # SPAN at most
    shared = spark.sparkContext.broadcast((seed_filter(item_seeds.df), spans))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    regions = stored(own.mapInArrow(_scan(shared), HITS).withColumn("words_id", F.xxhash64("words")), "regions")
    hits = regions.df.select("doc_id", "region", "words_id", F.explode("hits").alias("hit")).select("doc_id", "region", "words_id", "hit.seed", F.col("hit.at").alias("doc_at"))
    lined = (hits.join(item_seeds.df.drop("span"), "seed").select("doc_id", "region", "words_id", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).distinct())
    texts = items.mapInArrow(_item_words, "item_id long, item_words binary")
    rows = (lined.join(regions.df.drop("hits"), ["doc_id", "region", "words_id"]).join(texts, "item_id")
            .select("doc_id", "item_id", "first", "shift", "words", "item_words"))
    best = F.max_by(F.struct("n_words", "n_equal", "doc_start", "item_start"), F.struct("n_equal", -F.col("doc_start"), -F.col("item_start")))
    found = (rows.mapInArrow(_verify(identity, min_words), "doc_id long, item_id long, n_words long, n_equal long, doc_start long, item_start long")
             .groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*"))
    out = stored(found, "leaks")
    regions.drop()
    item_seeds.drop()
    return out.df


def op5(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_leaks(documents, benchmark)
