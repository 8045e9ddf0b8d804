"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import bytedups, langid, leaks, lines, mixing, negatives, pages, private, search, shards, simhash, substrings, whitening
from tandem.llm.storage import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda spark, d: langid.op1(_table(spark, d, "documents")),
    "op2_source_mixing": lambda spark, d: mixing.op2(_table(spark, d, "documents")),
    "op3_substring_dedup": lambda spark, d: substrings.op3(_table(spark, d, "documents")),
    "op4_line_dedup": lambda spark, d: lines.op4(_table(spark, d, "documents")),
    "op5_decontamination": lambda spark, d: leaks.op5(_table(spark, d, "documents"), _table(spark, d, "benchmark")),
    "op6_simhash": lambda spark, d: simhash.op6(_table(spark, d, "documents")),
    "op7_top_products": lambda spark, d: search.op7(_table(spark, d, "embeddings")),
    "op8_main_text": lambda spark, d: pages.op8(_table(spark, d, "pages")),
    "op9_suffix_array_dedup": lambda spark, d: bytedups.op9(_table(spark, d, "documents")),
    "op10_private_data": lambda spark, d: private.op10(_table(spark, d, "documents")),
    "op11_whitening": lambda spark, d: whitening.op11(_table(spark, d, "embeddings")),
    "op12_hard_negatives": lambda spark, d: negatives.op12(_table(spark, d, "embeddings")),
    "op13_kd_shards": lambda spark, d: shards.op13(_table(spark, d, "documents")),
}

ORACLES: dict[str, str] = {"op2_source_mixing": mixing.OP2_SQL, "op4_line_dedup": lines.OP4_SQL, "op7_top_products": search.OP7_SQL,
                           "op12_hard_negatives": negatives.OP12_SQL}
