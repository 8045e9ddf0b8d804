"""Readers and writers of bar tables and file inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandem import schemas
from tandem.functions.timeline import format_ib_time, ib_time
from tandem.operators.clean import long_to_wide, wide_to_long


def read_bars_wide(spark: SparkSession, path: str, drop_gaps: bool = False) -> DataFrame:
    """CSV with two header rows (symbols, fields) and a time index -> long bars.

    Only the two header lines come to the driver.  ``drop_gaps`` leaves out
    times at which any cell is empty.
    """
    head = [r.value for r in spark.read.text(path).limit(3).collect()]
    symbols, fields = (line.split(",") for line in head[:2])
    names = ["ts"] + [f"{f}_{s}" for s, f in zip(symbols[1:], fields[1:])]
    schema = ", ".join(f"`{n}` STRING" if n == "ts" else f"`{n}` DOUBLE" for n in names)
    # The third line may name the index; it has no values then.  Only these lines are left out: a time that cannot be
    # read is an error, not a line to drop.
    named = head[:3] if len(head) > 2 and not any(c.strip() for c in head[2].split(",")[1:]) else head[:2]
    lines = spark.read.text(path).where(~F.col("value").isin(named) & (F.trim("value") != ""))
    body = lines.select(F.from_csv("value", schema).alias("r")).select("r.*").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    if drop_gaps:
        body = body.dropna()
    return wide_to_long(body)


def read_bars_flat(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header ``time,open_SYM,..,wap_SYM`` -> long bars."""
    wide = spark.read.option("header", True).csv(path)
    values = [c for c in wide.columns if c != "time"]
    wide = wide.select(ib_time("time").alias("ts"), *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return wide_to_long(wide)


def write_bars_flat(bars: DataFrame, symbols: Sequence[str], path: str,
                    fields: Sequence[str] = tuple(schemas.BAR_FIELDS), ordered: bool = True) -> None:
    """Flat wide CSV; the symbol list is explicit so the pivot needs no extra pass."""
    wide = long_to_wide(bars, symbols, fields)
    wide = wide.orderBy("ts") if ordered else wide
    cols = [f"{f}_{s}" for s in symbols for f in fields]
    wide.select(format_ib_time("ts").alias("time"), *cols).write.option("header", True).csv(path)


def write_bars_wide(bars: DataFrame, symbols: Sequence[str], path: str,
                    fields: Sequence[str] = tuple(schemas.BAR_FIELDS)) -> None:
    """Two-header-row CSV.  Every part file carries both header lines, as one line of text each."""
    wide = long_to_wide(bars, symbols, fields).orderBy("ts")
    cells = [F.coalesce(F.col(f"{f}_{s}").cast("string"), F.lit("")) for s in symbols for f in fields]
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), *cells)
    heads = ",".join(["symbol"] + [s for s in symbols for _ in fields]), ",".join(["date"] + [f for _ in symbols for f in fields])
    rows = wide.select(line.alias("value"))

    def with_heads(parts):
        import pandas as pd
        first = True
        for p in parts:
            if first and len(p):
                yield pd.DataFrame({"value": list(heads)})
                first = False
            yield p

    rows.mapInPandas(with_heads, "value string").write.text(path)


def read_kline(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV (file or folder of parts) per symbol and interval, named ``CODE.KTYPE.csv``; codes may contain dots."""
    d = spark.read.schema(schemas.KLINE).option("header", True).option("recursiveFileLookup", True).csv(folder)
    name = F.col("_metadata.file_path")
    pattern = r"/([^/]+)\.(K1M|K5M|K30M|KD|KW|KMON|KY)\.csv(?:/[^/]*)?$"
    return d.select(F.regexp_extract(name, pattern, 1).alias("symbol"), F.regexp_extract(name, pattern, 2).alias("ktype"),
                    F.col("time_key").alias("ts"), "open", "high", "low", "close", "volume", "turnover")


def parse_inventory(files: DataFrame, name: str = "name") -> DataFrame:
    """``seq-SYM-start-end-interval`` names in five parts; others are left out."""
    p = F.split(name, "-")
    return (files.where(F.size(p) == 5).select(p[0].alias("seq"), p[1].alias("symbol"), p[2].alias("start"), p[3].alias("end"),
                                               F.regexp_replace(p[4], r"\.csv$", "").alias("interval")))


def scan_file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory rows of a folder; only the listing is used, no content is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("name")))
    return parse_inventory(files)


def group_inventory(inventory: DataFrame) -> DataFrame:
    """Each file with the number of files of its (start, end) group: rows, not lists, so a large group stays spread out."""
    sizes = inventory.groupBy("start", "end").agg(F.count(F.lit(1)).alias("files"))
    return inventory.join(sizes, ["start", "end"])


def shard_of(symbol: Column, shards: int = 20) -> Column:
    """sha1(symbol) mod ``shards`` as a number.

    Powers of 16 above the first are 16 modulo 20, so the 160-bit remainder is
    the last digit plus 16 times the sum of the others.
    """
    hashed = F.sha1(symbol.cast("binary"))
    number = lambda c: F.conv(c, 16, 10).cast("bigint")
    zero = F.lit(0).cast("bigint")
    if shards != 20:
        return F.aggregate(F.split(hashed, ""), zero, lambda a, c: (a * 16 + F.coalesce(number(c), zero)) % shards)
    others = F.aggregate(F.split(F.substring(hashed, 1, 39), ""), zero, lambda a, c: a + F.coalesce(number(c), zero))
    return (number(F.substring(hashed, 40, 1)) + others * 16) % 20


def write_bars_sharded(bars: DataFrame, path: str) -> None:
    """Parquet bars by symbol shard and day: both prune, and no shard outgrows its day folder."""
    d = bars.withColumn("shard", shard_of(F.col("symbol"))).withColumn("day", F.to_date("ts"))
    d.repartition("day", "shard").write.partitionBy("day", "shard").parquet(path)
