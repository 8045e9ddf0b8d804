"""Stock to plate (theme/industry) membership, as JSON and as a map column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandem import schemas


def invert_plates(rows: DataFrame, weight: float = 1.0) -> DataFrame:
    """(code, plate) lists -> one row per stock with a map plate -> weight.

    Duplicates collapse before the map is built, so a map holds at most one
    entry per existing plate.
    """
    clean = rows.select(F.regexp_replace("code", r"^US\.", "").alias("symbol"), "plate").distinct()
    entry = F.struct(F.col("plate"), F.lit(weight).alias("weight"))
    return clean.groupBy("symbol").agg(F.map_from_entries(F.collect_list(entry)).alias("plates"))


def read_plates(spark: SparkSession, path: str, pretty: bool = False) -> tuple[DataFrame, DataFrame]:
    """(stocks, plate names) of plates documents, one per line (one per file when ``pretty``)."""
    doc = spark.read.schema(schemas.PLATES).option("multiLine", pretty).json(path)
    stocks = doc.select(F.explode("stocks").alias("symbol", "_s")).select("symbol", "_s.*")
    names = doc.select(F.explode("plateCodeToCnName").alias("code", "name"))
    return stocks, names


def write_plates(stocks: DataFrame, names: DataFrame, path: str, parts: int = 64) -> None:
    """Write JSON documents of the plates shape, one per hash part of the stocks.

    Every document carries the plate names its own stocks use, so parts can be
    read alone or together and no document holds the whole universe.
    """
    s = stocks.withColumn("_part", F.pmod(F.xxhash64("symbol"), F.lit(parts)))
    stock = F.struct(F.col("symbol").alias("code"), "stock_name", "list_time", "plates")
    docs = s.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("symbol", stock))).alias("stocks"))
    used = (s.select("_part", F.explode(F.map_keys("plates")).alias("code")).distinct().join(names, "code")
            .groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("code", "name"))).alias("plateCodeToCnName")))
    docs.join(used, "_part", "left").drop("_part").write.json(path)
