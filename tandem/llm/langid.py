"""Language ID with language-bitmask n-gram filters.

Each slot of one Bloom filter holds a bitmask of languages, not a bit: inserting an n-gram of a language sets the
bit of that language in ``HASHES`` slots, and the AND of the slots of an n-gram gives every language that may contain
it in one lookup.  A text is looked up n-gram by n-gram; the population count of each language, less the hits that
the filter's own fill lets expect, decides.

N-grams are four bytes of the lower-cased UTF-8 text in which everything but letters is a blank, with no blank
inside; they belong to a language if they are frequent there and not much rarer than in the language where they are
most frequent.  Learning reads ``text`` and ``lang`` only.

Bounds (parameters): about ``per_lang`` training documents of each language, at most ``max_grams`` n-grams of each
language, 2^``bits`` slots.  Up to 64 languages (a learned table of more raises an error).

Defined cases: null text or text without a letter: ``und``, score 0; a text with letters but no known n-gram: the
language with most training documents, score 0; ties: the alphabetically first language; rows without lang, with empty
text or no n-gram teach nothing; with no training rows at all every prediction is ``und``.  Repeated rows are separate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tandem.llm.storage import ready, stored
from tandem.llm.words import chunks

GRAM = 4
HASHES = 3
LETTER = re.compile(r"[^\W\d_]")
# Odd multipliers of the slot hashes.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _letters() -> np.ndarray:
    keep = np.full(256, 32, dtype=np.uint8)
    for c in range(97, 123):
        keep[c] = c
    keep[128:] = np.arange(128, 256)
    return keep


KEEP = _letters()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of all texts, and for each text where its codes start (one more entry at the end)."""
    raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = KEEP[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    if len(data) < GRAM:
        return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    letter = data != 32
    n = len(data) - GRAM + 1
    whole = letter[1:n + 1] & letter[2:n + 2]  # no blank inside; texts are set apart by two blanks
    at = np.flatnonzero(whole)
    code = data[at].astype(np.uint32)
    for k in range(1, GRAM):
        code |= data[at + k].astype(np.uint32) << np.uint32(8 * k)
    return code, np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))


def slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    wide = code.astype(np.uint64)
    return [((wide + np.uint64(1)) * m >> np.uint64(64 - bits)).astype(np.int64) for m in MULTIPLIERS]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = batch.column(1).to_pylist()
        for lo, hi in chunks(texts):
            for lang in sorted(set(langs[lo:hi])):
                code, _ = grams([texts[i] for i in range(lo, hi) if langs[i] == lang])
                values, counts = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)),
                                                  pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def _slotted(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy().astype(np.uint32)
            mask = batch.column(1).to_numpy()
            for s in slots(code, bits):
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(mask)], names=["slot", "mask"])
    return rows


@dataclass
class Model:
    """Languages in the order of their bits, the slot table, the share of slots that each has set, training documents."""

    langs: list[str]
    table: np.ndarray
    bits: int
    docs: list[int]

    @property
    def false_rate(self) -> np.ndarray:
        fill = [float(np.count_nonzero(self.table >> self.table.dtype.type(b) & self.table.dtype.type(1))) / len(self.table)
                for b in range(len(self.langs))]
        return np.array(fill) ** HASHES


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 3000,
          max_grams: int = 60_000, bits: int = 20, rare: float = 0.1, least: int = 3) -> Model:
    """Learn from the rows of ``docs`` (the caller leaves out what is held out)."""
    ready(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    counted = sorted(known.groupBy("lang").count().limit(65).collect())  # more than 64 are an error
    langs, sizes = [r[0] for r in counted], [r[1] for r in counted]
    if len(langs) > 64:
        raise ValueError("a slot has bits for 64 languages")
    if not langs:
        return Model([], np.zeros(1 << bits, np.uint8), bits, [])
    # the same documents at every run: a share of the hash range that holds about per_lang of them
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / n))) for lang, n in zip(langs, sizes)])
    drawn = known.where((F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 20)) < share * (1 << 20)))
    counts = stored(drawn.select("lang", "text").mapInArrow(_counted, "lang string, gram long, n long")
                    .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "grams")
    totals = counts.df.groupBy("lang").agg(F.sum("n").alias("all"))
    per_gram = Window.partitionBy("gram")
    top = Window.partitionBy("lang").orderBy(F.desc("rate"), "gram")
    kept = (counts.df.join(totals, "lang").withColumn("rate", F.col("n") / F.col("all"))
            .withColumn("best", F.max("rate").over(per_gram)).where(F.col("rate") >= rare * F.col("best"))
            .withColumn("place", F.row_number().over(top)).where(F.col("place") <= max_grams))
    bit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b, lang in enumerate(langs)])
    masks = kept.groupBy("gram").agg(F.bit_or(bit).alias("mask"))
    filled = masks.select("gram", "mask").mapInArrow(_slotted(bits), "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask"))
    got = filled.toPandas()  # at most 2^bits rows
    counts.drop()
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    table = np.zeros(1 << bits, kind)
    table[got["slot"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(np.uint64).astype(kind)
    return Model(langs, table, bits, sizes)


def counted_hits(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the n-grams that each language may contain, and all its n-grams."""
    code, ends = grams(texts)
    mask = None
    for s in slots(code, model.bits):
        hit = model.table[s]
        mask = hit if mask is None else mask & hit
    one = model.table.dtype.type(1)
    hits = np.zeros((len(texts), len(model.langs)))
    for b in range(len(model.langs)):
        upto = np.concatenate([[0], np.cumsum(mask >> model.table.dtype.type(b) & one, dtype=np.int64)])
        hits[:, b] = upto[ends[1:]] - upto[ends[:-1]]
    return hits, np.diff(ends)


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    found, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return found, scores
    has = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not has:
        return found, scores
    hits, n = np.zeros((len(has), len(model.langs))), np.zeros(len(has), dtype=np.int64)
    for lo, hi in chunks([texts[i] for i in has]):
        hits[lo:hi], n[lo:hi] = counted_hits(model, [texts[i] for i in has[lo:hi]])
    rate = model.false_rate
    real = np.clip((hits - n[:, None] * rate) / (1 - rate), 0, None)
    best = real.argmax(axis=1)
    total = real.sum(axis=1)
    usual = int(np.argmax(model.docs))
    for row, i in enumerate(has):
        if total[row] > 0:
            found[i], scores[i] = model.langs[best[row]], min(1.0, real[row, best[row]] / total[row])
        else:
            found[i] = model.langs[usual]
    return found, scores


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) and the language and score under ``names``; only the text is looked at.
    A column of ``docs`` that has one of these names is replaced.

    The model (a table of fixed size) goes to the workers as a broadcast variable.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = decide(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(langs, pa.string()), pa.array(scores)],
                                             names=[*batch.schema.names[:width], *names])

    out = [f for f in docs.schema if f.name not in names and (keep is None or f.name in keep)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out), f"`{names[0]}` string, `{names[1]}` double"])
    # the text crosses to Python once, as a column that is kept or under a name of its own
    own = any(f.name == text_col for f in out)
    read = docs.select(*[f"`{f.name}`" for f in out], *([] if own else [F.col(text_col).alias("_li_text")]))
    at, width = (([f.name for f in out].index(text_col), len(out)) if own else (len(out), len(out)))
    return read.mapInArrow(rows, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op1(documents: DataFrame) -> DataFrame:
    docs = documents.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = train(docs.where("not held_out"))
    return identify(docs, model, keep=["doc_id", "held_out"])
