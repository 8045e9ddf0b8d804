"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised.  The exponent is bisected on [0, 1] (0: all
sources alike, 1: their own shares) until the weights have the wanted entropy, or until no source has to be read more
often than ``max_epochs`` times to fill its part of the budget.  The weights become token budgets; a budget is filled
by reading the source in passes.  In each pass the blocks of the source stand in another pseudo-random order, and so
do the documents inside a block; the last pass ends where the next document would overrun the budget.

Only DataFrame functions.  Defined cases:

* a token is a maximal run of characters other than blank and U+0009-U+000D; null text: none;
* a null source is a source of its own; sources without tokens get no budget and no rows;
* documents without tokens come along in every full pass, and in the last one while the budget lasts;
* repeated rows of one ``doc_id`` are repeated in the result; ties of the order are broken by id, then by token count;
* an empty table gives an empty result.

Scale: a source's documents are dealt to about sqrt(documents) blocks by hash, sums over blocks come first and running
sums run inside one block, so a source with a third of all rows is no single task.  Each bisection step reads the
table of sources (not of documents) and brings back one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandem.llm.storage import stored

TOKEN = r"[^\x20\x09-\x0D]+"
STEPS = 30
DIGITS = 6


@dataclass(frozen=True)
class Target:
    """``entropy``: share of the largest possible entropy (log of the number of sources) to reach, or None;
    ``max_epochs``: passes over any source to stay within, or None; ``budget``: share of all tokens to draw."""

    entropy: float | None = 0.97
    max_epochs: float | None = None
    budget: float = 1.0
    seed: str = "mix"


def draw(*parts: Column | str) -> Column:
    """Pseudo-random key of 32 hexadecimal digits, the same on every engine and every retry."""
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def source_table(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("_mx_source").agg(F.sum("_mx_tokens").alias("_mx_t"), F.count(F.lit(1)).alias("_mx_docs")).where("_mx_t > 0")


@dataclass(frozen=True)
class Fitted:
    """Exponent, sum of the shares raised to it, tokens of all sources."""

    exponent: float
    norm: float
    tokens: int


def bisect_exponent(sources: DataFrame, target: Target) -> Fitted:
    """Bisect the exponent; every step is one aggregate over the sources that brings back one row.

    Entropy falls from its maximum at 0 as the exponent grows: the largest exponent with enough of it is taken.
    The most repeated source is repeated less as the exponent grows: the smallest within the limit is taken.
    """
    totals = sources.agg(F.sum("_mx_t").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not totals.n:
        return Fitted(1.0, 1.0, 0)
    share = F.col("_mx_t") / F.lit(float(totals.t))

    def sums(x: float):
        p = F.pow(share, F.lit(x))
        return sources.agg(F.sum(p).alias("z"), F.sum(p * F.ln(p)).alias("pl"), F.max(p / F.col("_mx_t")).alias("most")).first()

    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        row = sums(mid)
        if target.entropy is not None:
            rises = math.log(row.z) - row.pl / row.z >= target.entropy * math.log(totals.n)
        else:
            rises = row.most / row.z * target.budget * totals.t > target.max_epochs
        lo, hi = (mid, hi) if rises else (lo, mid)
    exponent = round(lo if target.entropy is not None else hi, DIGITS)
    return Fitted(exponent, sums(exponent).z, totals.t)


def budgets(sources: DataFrame, fitted: Fitted, target: Target) -> DataFrame:
    """Weight, full passes and tokens of the last pass for each source."""
    weight = F.round(F.pow(F.col("_mx_t") / F.lit(float(fitted.tokens or 1)), F.lit(fitted.exponent)) / F.lit(fitted.norm), 9)
    budget = F.floor(F.col("_mx_weight") * F.lit(target.budget) * F.lit(float(fitted.tokens))).cast("long")
    return (sources.withColumn("_mx_weight", weight).withColumn("_mx_budget", budget)
            .withColumn("_mx_full", F.floor(F.col("_mx_budget") / F.col("_mx_t")).cast("long"))
            .select("_mx_source", "_mx_weight", "_mx_full", (F.col("_mx_budget") - F.col("_mx_full") * F.col("_mx_t")).alias("_mx_rest"),
                    F.ceil(F.sqrt("_mx_docs")).cast("long").alias("_mx_blocks")))


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        keep: list[str] | None = None) -> DataFrame:
    """Rows of the mixture: ``keep`` (columns of ``docs``), and ``_mx_id``, ``_mx_source``, ``_mx_tokens``, ``_mx_weight``,
    ``_mx_epoch`` (pass over the source, from 0), ``_mx_block``."""
    keep = keep or []
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long")
    base = docs.select(*[f"`{c}`" for c in keep], F.col(id_col).alias("_mx_id"), F.col(source_col).alias("_mx_source"), count.alias("_mx_tokens"))
    tokens = base if keep else stored(base, "tokens").df
    sources = stored(source_table(tokens), "sources")
    plan = stored(budgets(sources.df, bisect_exponent(sources.df, target), target), "budgets").df
    sources.drop()
    seed = target.seed
    # every document once for each full pass of its source, and once for the pass that the budget may cut
    block = F.conv(F.substring(draw(seed, F.col("_mx_id")), 1, 12), 16, 10).cast("long") % F.col("_mx_blocks")
    name = F.coalesce(F.concat(F.lit("s"), F.col("_mx_source")), F.lit("null"))
    dealt = (tokens.withColumn("_mx_key", name).join(plan.withColumn("_mx_key", name).drop("_mx_source"), "_mx_key").withColumn("_mx_block", block))
    full = dealt.where("_mx_full > 0").withColumn("_mx_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mx_full") - 1)))
    last = dealt.where("_mx_rest > 0").withColumn("_mx_epoch", F.col("_mx_full"))
    sums = last.groupBy("_mx_key", "_mx_block").agg(F.sum("_mx_tokens").alias("_mx_sum"), F.first("_mx_source").alias("_mx_source"),
                                                    F.first("_mx_full").alias("_mx_full"), F.first("_mx_rest").alias("_mx_rest"))
    order = draw(seed, F.col("_mx_full"), F.col("_mx_source"), F.col("_mx_block"))
    before = Window.partitionBy("_mx_key").orderBy(order, "_mx_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("_mx_before", F.coalesce(F.sum("_mx_sum").over(before), F.lit(0))).where("_mx_before <= _mx_rest")
              .select("_mx_key", "_mx_block", "_mx_before"))
    inside = Window.partitionBy("_mx_key", "_mx_block").orderBy(draw(seed, F.col("_mx_epoch"), F.col("_mx_id")), "_mx_id", "_mx_tokens")
    cut = (last.join(starts, ["_mx_key", "_mx_block"])
           .withColumn("_mx_upto", F.col("_mx_before") + F.sum("_mx_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
           .where("_mx_upto <= _mx_rest"))
    names = [*[f"`{c}`" for c in keep], "_mx_id", "_mx_source", "_mx_tokens", "_mx_weight", "_mx_epoch", "_mx_block"]
    return full.select(*names).unionByName(cut.select(*names))


def op2(documents: DataFrame) -> DataFrame:
    """Temperature mixture of the sources at 97 % of the largest entropy, as many tokens as there are.

    A row for every reading of a document: ``epoch`` counts the passes over its source; in a pass the documents stand
    by (md5 of seed, epoch, source, block), (md5 of seed, epoch, id).
    """
    return mix(documents).select(F.col("_mx_id").alias("doc_id"), F.col("_mx_source").alias("source"), F.col("_mx_tokens").alias("n_tokens"),
                       F.col("_mx_epoch").alias("epoch"), F.col("_mx_block").alias("block"), F.col("_mx_weight").alias("weight"))


OP2_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS t, count(*) AS docs FROM t GROUP BY source HAVING sum(n) > 0),
a AS (SELECT sum(t)::DOUBLE AS t, count(*) AS n FROM s),
b AS (SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT step + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
      FROM (SELECT step, lo, hi, (SELECT ln(sum(p)) - sum(p * ln(p)) / sum(p) >= 0.97 * ln(count(*))
                                  FROM (SELECT pow(s.t / a.t, (b.lo + b.hi) / 2) AS p FROM s, a)) AS ok
            FROM b WHERE step < 30)),
e AS (SELECT round(lo, 6) AS x FROM b WHERE step = 30),
w AS (SELECT source, s.t, docs, pow(s.t / a.t, x) AS p, a.t AS total FROM s, a, e),
g AS (SELECT source, t, docs, round(p / sum(p) OVER (), 9) AS weight, total FROM w),
h AS (SELECT source, t, ceil(sqrt(docs))::BIGINT AS blocks, weight, floor(weight * 1.0 * total)::BIGINT AS budget FROM g),
d AS (SELECT doc_id, t.source, n, weight, budget // h.t AS passes, budget % h.t AS rest,
             CAST('0x' || substr(md5('mix:' || doc_id), 1, 12) AS BIGINT) % blocks AS block
      FROM t JOIN h ON t.source IS NOT DISTINCT FROM h.source),
f AS (SELECT *, unnest(range(passes)) AS epoch FROM d),
l AS (SELECT *, passes AS epoch FROM d WHERE rest > 0),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY md5('mix:' || epoch || ':' || source || ':' || block), block,
                             md5('mix:' || epoch || ':' || doc_id), doc_id, n ROWS UNBOUNDED PRECEDING) AS upto FROM l)
SELECT doc_id, source, n AS n_tokens, epoch, block, weight FROM f
UNION ALL
SELECT doc_id, source, n, epoch, block, weight FROM c WHERE upto <= rest
"""
