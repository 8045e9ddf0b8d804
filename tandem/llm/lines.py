"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position.

Only DataFrame functions.  Defined cases:

* a null text counts as one empty line and stays null; a document without any dropped line keeps its text as it is;
* a key shorter than ``min_chars`` code points is never dropped, whatever its count;
* rows that repeat a ``doc_id`` are one document: the key of a line counts once for it, and a line is
  dropped from every row of a document that is not the first (smallest id) to hold it;
* a null ``doc_id`` is no document: its lines are neither counted nor dropped;
* a document all of whose lines go keeps an empty text; an empty table gives an empty result;
* other columns pass through; internal names start with ``_ld_``.

Hot keys: a line that a third of all documents share is counted with partial aggregates (a distinct
count first spreads over (key, document)); the join of lines with keys reads a written table on
both sides, so adaptive execution can split its partitions; lists are per document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tandem.llm.storage import Stored, stored

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each line whose key is long enough: document, hash of its text, position, 128-bit key hash."""
    key = line_key(F.col("_ld_line"))
    return (docs.select(F.col(id_col).alias("_ld_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_ld_t"))
            .where("_ld_id is not null")
            .select("_ld_id", F.xxhash64("_ld_t").alias("_ld_th"), F.posexplode(F.split("_ld_t", "\n", -1)).alias("_ld_pos", "_ld_line"))
            .select("_ld_id", "_ld_th", "_ld_pos", key.alias("_ld_key"))
            .where(F.char_length("_ld_key") >= min_chars)
            .select("_ld_id", "_ld_th", "_ld_pos", F.xxhash64("_ld_key").alias("_ld_h1"),
                    F.xxhash64(F.lit("second"), F.col("_ld_key")).alias("_ld_h2")))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys that at least ``min_docs`` documents hold, with the smallest of those."""
    return (lines.groupBy("_ld_h1", "_ld_h2").agg(F.count_distinct("_ld_id").alias("_ld_n"), F.min("_ld_id").alias("_ld_first"))
            .where(F.col("_ld_n") >= min_docs).select("_ld_h1", "_ld_h2", "_ld_first"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the text that is left, and ``_ld_lines``, ``_ld_dropped`` (counts)."""
    lines: Stored = stored(line_table(docs, id_col, text_col, min_chars), "lines")
    keys = stored(repeated_keys(lines.df, min_docs), "keys")
    drops = stored(lines.df.join(keys.df, ["_ld_h1", "_ld_h2"]).where("_ld_id <> _ld_first")
                   .groupBy("_ld_id", "_ld_th").agg(F.collect_set("_ld_pos").alias("_ld_gone")), "drops")
    lines.drop()
    keys.drop()
    own = (docs.withColumn("_ld_id", F.col(id_col)).withColumn("_ld_null", F.col(text_col).isNull()).withColumn("_ld_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
           .withColumn("_ld_all", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).drop(text_col))
    joined = own.join(drops.df, ["_ld_id", "_ld_th"], "left")
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("_ld_all") - 1), F.col("_ld_gone"))
    kept = F.when(F.col("_ld_gone").isNull(), F.col("_ld_all")).otherwise(F.transform(kept_at, lambda p: F.get("_ld_all", p)))
    out = joined.withColumn(text_col, F.when(~F.col("_ld_null"), F.array_join(kept, "\n")))
    return out.select(*docs.columns, F.size("_ld_all").cast("long").alias("_ld_lines"),
                      F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("_ld_dropped"))


def op4(documents: DataFrame) -> DataFrame:
    done = drop_repeated_lines(documents.select("doc_id", "text"))
    return done.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.first_doc AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
