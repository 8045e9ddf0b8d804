"""Pushed feeds as typed streams, their hourly archive, and run helpers."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem import schemas
from tandem.sources.shared import fresh_path


def stream_feed(spark: SparkSession, kind: str, path: str, fmt: str = "json", files_per_trigger: int | None = None,
                **options) -> DataFrame:
    """A feed (ticker, quote, intraday, kline) from files that keep arriving in a folder."""
    reader = spark.readStream.schema(schemas.FEEDS[kind]).format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def parse_feed(messages: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """A feed out of a message-bus stream whose value is one JSON row."""
    return messages.select(F.from_json(F.col(value).cast("string"), schemas.FEEDS[kind]).alias("_f")).select("_f.*")


def quote_fields(ticks: DataFrame, price: str = "price", half_spread: float = 0.001) -> DataFrame:
    """(symbol, ts, field, price) rows as a market-data callback would deliver them."""
    fields = F.array(*[F.struct(F.lit(n).alias("field"), (F.col(price) * k).alias("price"))
                       for n, k in (("BID", 1 - half_spread), ("ASK", 1 + half_spread), ("LAST", 1.0), ("CLOSE", 1.0))])
    return ticks.select("symbol", "ts", F.explode(fields).alias("_f")).select("symbol", "ts", "_f.*")


def sink_hourly(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", **trigger) -> StreamingQuery:
    """Append to files by date and hour of the event time."""
    d = stream.withColumns({"date": F.date_format(ts, "yyyyMMdd"), "hour": F.date_format(ts, "HH")})
    return (d.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .partitionBy("date", "hour").outputMode("append").trigger(**(trigger or {"processingTime": "1 minute"})).start())


@contextmanager
def _state_partitions(spark: SparkSession):
    """State partitions are fixed at the first start: one per core instead of the batch default."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which arbitrary-state processors need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


@contextmanager
def sessions_by_split(spark: SparkSession):
    """Queries started inside merge the sessions of each split before the shuffle, and splits are small: what a task sorts is
    bounded, and a busy key brings sessions, not all its rows, to one task."""
    want = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true", "spark.sql.files.maxPartitionBytes": "16m"}
    before = {k: spark.conf.get(k) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def heartbeat(rows: DataFrame, path: str, ts: str, at, **values) -> None:
    """Append to a folder of arriving files one row that only tells the time: the watermark moves on to ``at``."""
    cells = [F.lit(at if f.name == ts else values.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    rows.sparkSession.range(1).select(*cells).write.mode("append").parquet(path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, append mode, and read the result back."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    with _state_partitions(spark):
        q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], DataFrame], name: str, mode: str = "complete") -> DataFrame:
    """Run ``handle`` on every micro-batch; the last result is read back."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    shape = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        out = handle(batch, batch_id)
        shape["schema"] = out.schema
        out.write.mode("overwrite").parquet(path)

    with _state_partitions(spark):
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(shape["schema"]).parquet(path)
