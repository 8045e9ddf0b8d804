"""Pushed feeds as a data source with offsets, and an archive that a batch enters whole or not at all.

``push_feed`` reads the landing folder of a gateway: one append-only file of lines for each channel.  An offset is the
position in bytes of every channel, always behind a whole line, so a restarted query goes on exactly where its
checkpoint says.  New channels may appear; a batch is cut into splits of ``splitBytes``, read by tasks.  What a query has
committed is told to the gateway in ``ackPath/<reader>.json`` (it may drop what lies before).

``push_archive`` writes Parquet files by date and hour.  Tasks write files that nothing refers to yet (first phase); the
driver then puts the batch's manifest in place by one rename (second phase).  A batch that is run again finds its
manifest and only removes what the tasks wrote anew; a failed batch leaves nothing that ``read_archive`` can see.
Manifests are named by ``writer``, which must stay the same for a query and its checkpoint.

Both go through ``pyarrow.fs``, so the folders may lie in any store that it can open.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage)
from pyspark.sql.types import StructType

LINES = "channel STRING, position BIGINT, value STRING"
SPLIT_BYTES = 64 << 20
LINES_AT_ONCE = 8192
BLOCK = 1 << 20


def _store(path: str):
    """File system and path inside it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _replace(store, path: str, text: str) -> None:
    """Write a small file so that it is there whole or not at all."""
    store.create_dir(posixpath.dirname(path), recursive=True)
    staged = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(staged) as out:
        out.write(text.encode())
    store.move(staged, path)


@dataclass
class Split(InputPartition):
    """Lines of one channel that begin at ``lo`` or later and before ``hi``; the batch begins at ``first``."""

    channel: str
    first: int
    lo: int
    hi: int


class PushReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.ack, self.name = options.get("ackpath"), options.get("reader", "reader")

    def initialOffset(self) -> dict:
        return {}

    def _whole_lines(self, store, path: str, size: int) -> int:
        """End of the last complete line: a line that is being written belongs to the next batch."""
        with store.open_input_file(path) as f:
            hi = size
            while hi > 0:
                lo = max(0, hi - BLOCK)
                f.seek(lo)
                at = f.read(hi - lo).rfind(b"\n")
                if at >= 0:
                    return lo + at + 1
                hi = lo
        return 0

    def latestOffset(self) -> dict:
        from pyarrow import fs
        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=False))
        return {f.base_name: self._whole_lines(store, f.path, f.size) for f in sorted(found, key=lambda f: f.base_name)
                if f.is_file and not f.base_name.startswith(("_", "."))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for channel, hi in end.items():
            lo = start.get(channel, 0)
            if hi < lo:
                raise ValueError(f"channel {channel} was cut: it ends at {hi}, the query has read up to {lo}")
            out += [Split(channel, lo, at, min(hi, at + self.split)) for at in range(lo, hi, self.split)]
        gone = sorted(c for c in start if c not in end)
        if gone:
            raise ValueError(f"channels have gone: {gone[:5]}")
        return out

    def read(self, partition: Split) -> Iterator:
        import pyarrow as pa
        store, root = _store(self.path)
        with store.open_input_file(posixpath.join(root, partition.channel)) as f:
            begin = partition.lo
            if partition.lo > partition.first:  # a line that began before belongs to the split before
                begin -= 1
            f.seek(begin)
            rest, at, skip, done = b"", begin, partition.lo > partition.first, False
            positions, values = [], []
            while not done:
                block = f.read(BLOCK)
                if not block:
                    break
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    where, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                        continue
                    if where >= partition.hi:
                        done = True
                        break
                    positions.append(where)
                    values.append(line)
                    if len(values) == LINES_AT_ONCE:
                        yield self._batch(pa, partition.channel, positions, values)
                        positions, values = [], []
            if values:
                yield self._batch(pa, partition.channel, positions, values)

    @staticmethod
    def _batch(pa, channel: str, positions: list[int], values: list[bytes]):
        text = [v.decode("utf-8", "replace") for v in values]
        return pa.RecordBatch.from_arrays([pa.array([channel] * len(text)), pa.array(positions, pa.int64()), pa.array(text, pa.string())],
                                          names=["channel", "position", "value"])

    def commit(self, end: dict) -> None:
        if self.ack:
            store, root = _store(self.ack)
            _replace(store, posixpath.join(root, f"{self.name}.json"), json.dumps(end))

    def stop(self) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArchiveWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        if "writer" not in options:
            raise ValueError("option writer is needed: it names the query in the manifests")
        self.path, self.ts, self.name = options["path"], options.get("ts", "ts"), options["writer"]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        store, root = _store(self.path)
        files, open_ = [], {}
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            place = pc.fill_null(pc.strftime(table.column(self.ts), format="date=%Y%m%d/hour=%H"), "date=none/hour=none")
            for folder in pc.unique(place).to_pylist():
                if folder not in open_:
                    name = f"{folder}/part-{uuid.uuid4().hex}.parquet"
                    store.create_dir(posixpath.join(root, folder), recursive=True)
                    open_[folder] = pq.ParquetWriter(store.open_output_stream(posixpath.join(root, name)), table.schema, compression="zstd")
                    files.append(name)
                open_[folder].write_table(table.filter(pc.equal(place, folder)))
        for w in open_.values():
            w.close()
        return Written(files)

    def _manifest(self, root: str, batch: int) -> str:
        return posixpath.join(root, "_manifests", f"{self.name}-{batch:09d}.json")

    def _remove(self, store, root: str, messages) -> None:
        for m in messages:
            for f in m.files if m is not None else []:
                store.delete_file(posixpath.join(root, f))

    def commit(self, messages, batchId: int) -> None:
        from pyarrow import fs
        store, root = _store(self.path)
        manifest = self._manifest(root, batchId)
        if store.get_file_info(manifest).type != fs.FileType.NotFound:
            self._remove(store, root, messages)
            return
        files = [f for m in messages if m is not None for f in m.files]
        _replace(store, manifest, "".join(json.dumps({"file": f, "writer": self.name, "batch": batchId}) + "\n" for f in files))

    def abort(self, messages, batchId: int) -> None:
        store, root = _store(self.path)
        self._remove(store, root, messages)


class PushFeed(DataSource):
    """``spark.readStream.format("push_feed").option("path", folder)``: lines of all channels."""

    @classmethod
    def name(cls) -> str:
        return "push_feed"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PushReader(dict(self.options))


class PushArchive(DataSource):
    """``writeStream.format("push_archive").option("path", folder).option("writer", name)``: Parquet by date and hour of ``ts``."""

    @classmethod
    def name(cls) -> str:
        return "push_archive"

    def schema(self) -> str:
        return LINES

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return ArchiveWriter(dict(self.options))


def by_hour(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of an hour of ``ts`` in one task: an archive's files then follow its hours, not its splits times its hours."""
    return rows.repartition(F.date_trunc("hour", ts))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PushFeed)
    spark.dataSource.register(PushArchive)


def read_archive(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of all batches whose manifest is in place."""
    store, root = _store(path)
    from pyarrow import fs
    found = store.get_file_info(fs.FileSelector(posixpath.join(root, "_manifests"), allow_not_found=True))
    if not any(f.path.endswith(".json") for f in found):
        return spark.createDataFrame([], schema)
    listed = spark.read.schema("file STRING, writer STRING, batch LONG").option("pathGlobFilter", "*.json").json(f"{path}/_manifests")
    files = [f"{path}/{r.file}" for r in listed.select("file").collect()]  # file names, as any listing of a table
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Typed rows of the pushed lines, beside channel and position; a line that is no JSON gives nulls."""
    return lines.select("channel", "position", F.from_json("value", schema).alias("_v")).select("channel", "position", "_v.*")
