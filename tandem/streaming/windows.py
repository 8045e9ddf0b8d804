"""Joins by time range and session windows of streams, and a route for rows that come too late."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def interval_join(left: DataFrame, right: DataFrame, by: str, seconds: int, ts: str = "ts", right_ts: str = "bar_ts", delay: str = "10 minutes",
                  how: str = "inner") -> DataFrame:
    """Rows of ``left`` beside the rows of ``right`` of the last ``seconds`` seconds: right_ts <= ts < right_ts + seconds.

    Either side may come first.  Both sides have a watermark and the condition bounds the times, so a row leaves the
    state once no partner can come any more.  Time is part of the join key: a right row is kept under the (at most two)
    spans of ``seconds`` in which its partners may lie, a left row under its own.  One busy key therefore spreads over
    partitions by time, and a new row is only compared with rows of its span.  ``how="leftOuter"`` also returns left rows
    without a partner, after the watermark has passed their range.
    """
    span = lambda c: F.floor(F.unix_seconds(F.col(c)) / F.lit(seconds))
    l = left.withWatermark(ts, delay).withColumn("_span", span(ts))
    last = F.floor((F.unix_micros(F.col(right_ts)) + F.lit(seconds * 1_000_000 - 1)) / F.lit(seconds * 1_000_000))
    r = (right.withWatermark(right_ts, delay).withColumn("_r_span", F.explode(F.sequence(span(right_ts), last)))
         .withColumnRenamed(by, "_r_by"))
    inside = F.expr(f"{by} = _r_by AND _span = _r_span AND {right_ts} <= {ts} AND {ts} < {right_ts} + INTERVAL {int(seconds)} SECONDS")
    return l.join(r, inside, how).drop("_span", "_r_span", "_r_by")


def session_bars(ticks: DataFrame, gap_secs: Column | str, delay: str = "10 minutes", order: Column | str = "ts") -> DataFrame:
    """A row for each session of a symbol: its ticks follow each other within the symbol's own gap.

    A session is final once the watermark has passed its end (last tick plus gap).
    """
    gap = F.col(gap_secs) if isinstance(gap_secs, str) else gap_secs
    key = F.col(order) if isinstance(order, str) else order
    w = F.session_window("ts", F.concat(gap.cast("string"), F.lit(" seconds")))
    return (ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("session"))
            .agg(F.count(F.lit(1)).alias("n"), F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", key).alias("close"), F.max("ts").alias("last_ts"))
            .select("symbol", F.col("session.start").alias("ts"), "last_ts", "n", "open", "high", "low", "close"))


class LateRoute:
    """Splits a stream into rows in time and rows that come too late, each in a table of its own; none is lost.

    A row is late if its time is more than ``delay_secs`` behind the latest time of all earlier batches: the rule by
    which a watermark with that delay would drop it.  A stateful query that reads ``on_time`` as a stream with the same
    delay therefore drops nothing.

    A micro-batch is written to a staging folder and then renamed to its place; the batch's mark, which also carries the
    latest time on, comes last.  A batch that is run again after a failure finds what is already in its place and writes
    only the rest, so each row is in exactly one table once.
    """

    def __init__(self, spark: SparkSession, folder: str, ts: str = "ts", delay_secs: int = 600):
        self.spark, self.folder, self.ts, self.delay = spark, folder.rstrip("/"), ts, delay_secs

    @property
    def on_time(self) -> str:
        return f"{self.folder}/on_time"

    @property
    def late(self) -> str:
        return f"{self.folder}/late"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _exists(self, name: str) -> bool:
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self._path(name))

    def _put(self, rows: DataFrame, table: str, batch: int) -> None:
        place, staged = f"{self.folder}/{table}/batch={batch}", f"{self.folder}/staging/{table}-{batch}"
        if self._exists(place):
            return
        rows.write.mode("overwrite").parquet(staged)
        fs = self._path(place).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(self._path(f"{self.folder}/{table}"))
        if not fs.rename(self._path(staged), self._path(place)):
            raise OSError(f"{staged} could not be renamed to {place}")

    def _latest(self, batch: int) -> int | None:
        mark = f"{self.folder}/marks/batch={batch}"
        if batch < 0 or not self._exists(mark):
            return None
        return self.spark.read.schema("latest_us LONG").parquet(mark).first().latest_us  # one row

    def write(self, batch: DataFrame, batch_id: int) -> None:
        before = self._latest(batch_id - 1)
        us = F.unix_micros(F.col(self.ts))
        late = F.lit(False) if before is None else F.coalesce(us < F.lit(before - self.delay * 1_000_000), F.lit(False))
        batch.persist()
        try:
            seen = batch.agg(F.max(us)).first()[0]
            self._put(batch.where(~late), "on_time", batch_id)
            self._put(batch.where(late), "late", batch_id)
            latest = max((v for v in (before, seen) if v is not None), default=None)
            self._put(self.spark.range(1).select(F.lit(latest).cast("long").alias("latest_us")), "marks", batch_id)
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()

    def read(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{table}")

    def stream(self, schema) -> DataFrame:
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(self.on_time)


def in_steps(rows: DataFrame, path: str, steps: list[Column], arrived: Callable[[], None]) -> None:
    """Write ``rows`` as files that come step by step and call ``arrived`` after each (for replays: a row comes with the first step it meets).

    A step has as many files as ``rows`` has partitions.  A query that ``arrived`` runs to its end takes them as one micro-batch.
    """
    left = F.lit(True)
    for step in steps:
        rows.where(left & step).write.mode("append").parquet(path)
        arrived()
        left = left & ~step
