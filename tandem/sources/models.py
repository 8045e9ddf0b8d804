"""Pair models, universes, screener and insider files, result documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandem import schemas
from tandem.functions.timeline import epoch_micros

MODEL_PATH = r"(20[-0-9]+)\.([^/]*)/(ols\.csv|js_coint_v2\.json)"
DECIMALS = 5


def read_pairs(spark: SparkSession, *paths: str, schema: str = schemas.PAIR_OLS) -> DataFrame:
    """Several pair CSVs as one table; columns are taken by name, missing ones are NULL."""
    parts = None
    for p in paths:
        raw = spark.read.option("header", True).csv(p)
        wanted = [(f.name, f.dataType) for f in spark.createDataFrame([], schema).schema]
        typed = raw.select(*[(F.col(f"`{n}`") if n in raw.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])
        parts = typed if parts is None else parts.unionByName(typed)
    return parts


def read_models(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON-lines pair models with their date and group from the path."""
    d = spark.read.schema(schemas.PAIR_JS).json(list(paths))
    return d.select("*", F.col("_metadata.file_path").alias("path"))


def model_path_key(path: str | Column = "path", kind: str = r"(?:ols\.csv|js_coint_v2\.json)") -> tuple[Column, Column]:
    """(model date, group) of ``…/<date>.<group>/<file>``; any other path fails the job."""
    p = F.col(path) if isinstance(path, str) else path
    pattern = rf"(20[-0-9]+)\.([^/]*)/{kind}"
    date = F.regexp_extract(p, pattern, 1)
    checked = F.when(date == "", F.raise_error(F.concat(F.lit("not a model path: "), p))).otherwise(date)
    return checked.cast("string"), F.regexp_extract(p, pattern, 2)


def read_universe(lists: DataFrame, keys: Sequence[str], symbols: str = "symbols") -> DataFrame:
    """Comma lists per group -> (keys, symbol): trimmed, ``/`` as blank, empties and repeats dropped."""
    s = F.trim(F.replace(F.col("_s"), F.lit("/"), F.lit(" ")))
    return (lists.select(*keys, F.explode(F.split(symbols, ",")).alias("_s")).select(*keys, s.alias("symbol"))
            .where("symbol <> ''").distinct())


def read_universe_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"group": "A,B,C", ...}`` documents -> (grp, symbol)."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING,STRING>").alias("m"))
    return read_universe(doc.select(F.explode("m").alias("grp", "symbols")), ["grp"])


def read_screener(spark: SparkSession, path: str) -> DataFrame:
    """Screener CSV with prices as ``$1.23``: (symbol, price, volume, market_cap)."""
    from tandem.operators.clean import parse_money
    d = spark.read.schema(schemas.SCREENER).option("header", True).csv(path)
    return d.select(F.trim("Symbol").alias("symbol"), parse_money("Last Sale").alias("price"), F.col("Volume").alias("volume"),
                    F.col("Market Cap").alias("market_cap"))


def read_insiders(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INSIDERS).option("header", True).csv(path)


def model_rows(models: DataFrame) -> DataFrame:
    """Model columns as they are stored: 5 decimals, times as epoch milliseconds."""
    out = []
    for f in models.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = F.round(c, DECIMALS)
        elif kind in ("timestamp_ntz", "timestamp"):
            c = F.floor(epoch_micros(f.name) / 1000).cast("bigint")
        out.append(c.alias(f.name))
    return models.select(*out)


def write_models(models: DataFrame, path: str) -> None:
    """JSON lines, one model a line."""
    model_rows(models).write.json(path)


def scenario_results(models: DataFrame, trades: DataFrame, scenario: Sequence[str], parts: int = 16) -> DataFrame:
    """Nested result: scenario{keys, part, contracts[{name, trades[..], model{..}}]}.

    A contract holds the trades of one test range (at most one per bar), and the
    contracts of one scenario are spread over ``parts`` documents.
    """
    keys = list(scenario)
    trade = F.struct(*[c for c in trades.columns if c not in (*keys, "pair")])
    listed = trades.groupBy(*keys, "pair").agg(F.array_sort(F.collect_list(trade)).alias("trades"))
    model = F.struct(*[c for c in models.columns if c not in (*keys, "pair")]).alias("model")
    contracts = models.select(*keys, F.col("pair").alias("name"), model).join(
        listed.withColumnRenamed("pair", "name"), [*keys, "name"], "left")
    empty = F.array().cast(listed.schema["trades"].dataType)
    contract = F.struct("name", F.coalesce("trades", empty).alias("trades"), "model")
    contracts = contracts.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    return contracts.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(contract)).alias("contracts"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.json(path)
