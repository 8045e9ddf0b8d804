"""Intermediate tables of the training-data operators.

Every table lies in the folder that ``spark.checkpoint.dir`` names, so a lost
executor costs no more than the tasks it ran.  A table is dropped as soon as
nothing reads it any more, and the shuffle files of the job that wrote it are
released with it: disk use is that of the largest job, not their sum.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tandem.sources.shared import fresh_path, ship_package

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the jobs run inside are removed when each job ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def ready(spark: SparkSession) -> None:
    """The package on the workers, and Arrow batches bounded by bytes as well as by rows (texts may be very long)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(12 << 20))


class Stored:
    """A written table; ``df`` reads it, ``drop`` removes its files."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        ready(spark)
        self.spark, self.path = spark, fresh_path(spark, name)
        with freed_shuffles(spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> Stored:
    return Stored(df, name)


def parts_for(amount: float, per_part: float, least: int = 1) -> int:
    """Number of parts so that each holds about ``per_part``; grows with the amount."""
    return max(least, int(-(-amount // per_part)))
