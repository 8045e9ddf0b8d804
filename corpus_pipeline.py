"""The training-data pipeline: language ID, line dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next one.  All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem.llm import langid, leaks, lines, mixing, simhash
from tandem.llm.storage import stored

#: Below this share of the winning language among all languages' hits no language is recognised (unknown text: 0).
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; without letters or known n-grams they go."""
    model = langid.train(docs)
    found = langid.identify(docs, model, names=("_cp_lang", "_cp_score"))
    return found.where((F.col("_cp_lang") != "und") & (F.col("_cp_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text."""
    done = lines.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("_ld_dropped") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        done = done.withColumn("n_chars", changed)
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = leaks.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = found.select(F.col("doc_id").alias("_cp_id")).distinct()
    return docs.join(ids, F.col("doc_id") == F.col("_cp_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each reading of a document with the pass, the block and the weight of its source.

    Columns of ``docs`` that have the name of one of these three (in any case) are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in ("mix_epoch", "mix_block", "mix_weight")]
    rows = mixing.mix(docs, keep=keep)
    return rows.select(*[f"`{c}`" for c in keep], F.col("_mx_epoch").alias("mix_epoch"), F.col("_mx_block").alias("mix_block"), F.col("_mx_weight").alias("mix_weight"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources)]

#: Language ID, near-dedup and decontamination are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            table = stored(docs, name)
            if before is not None:
                before.drop()
            before, docs = table, table.df
    return docs
