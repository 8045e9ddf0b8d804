"""The shared folder in which intermediate tables are written."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder the cluster names in ``spark.checkpoint.dir``.

    Only where a session names none (local tests) a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        app = spark.sparkContext.applicationId
        folder = _local.get(app)
        if folder is None:
            folder = _local[app] = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the package to the workers, whatever folder the driver was started in."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tandem.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("tandem", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


_made: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; its files go when the process ends."""
    root = f"{shared_folder(spark)}/tandem-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made)
    _made.add(root)
    return f"{root}/{name}"


def _remove_made() -> None:
    """Remove what is left of the written tables, if the session that can reach their folder still runs."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for root in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by a written table: survives the loss of executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
