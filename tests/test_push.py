"""Offsets of pushed feeds and the two phases of the archive."""

import datetime as dt
import json
import os

import pyarrow as pa
import pytest

from tandem.sources.shared import fresh_path
from tandem.streaming import push


def lines_between(reader, start, end):
    return [(b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py())
            for p in reader.partitions(start, end) for b in reader.read(p) for i in range(len(b))]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_every_line_is_read_once_however_the_bytes_are_split(tmp_path, split):
    texts = ["a", "", "bcd", "é" * 30, "x" * 100, "last"]
    (tmp_path / "one").write_bytes("\n".join(texts).encode() + b"\n")
    (tmp_path / "two").write_bytes(b"only\nbeing writ")
    (tmp_path / "_hidden").write_bytes(b"no\n")
    r = push.PushReader({"path": str(tmp_path), "splitbytes": str(split)})
    first = r.latestOffset()
    assert first == {"one": (tmp_path / "one").stat().st_size, "two": 5}
    got = lines_between(r, r.initialOffset(), first)
    assert [v for c, _, v in got if c == "one"] == texts and [v for c, _, v in got if c == "two"] == ["only"]
    raw = (tmp_path / "one").read_bytes()
    assert all(raw[p:p + len(v.encode())] == v.encode() for c, p, v in got if c == "one")
    with open(tmp_path / "two", "ab") as f:
        f.write(b"ten\nmore\n")
    (tmp_path / "three").write_bytes(b"new\n")
    second = r.latestOffset()
    assert sorted(v for *_, v in lines_between(r, first, second)) == ["being written", "more", "new"]
    assert lines_between(r, second, second) == []


def test_a_cut_channel_is_an_error(tmp_path):
    (tmp_path / "one").write_bytes(b"a\nb\n")
    r = push.PushReader({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="was cut"):
        r.partitions({"one": 9}, r.latestOffset())
    with pytest.raises(ValueError, match="have gone"):
        r.partitions({"other": 2}, r.latestOffset())


def batch(*hours):
    t = [None if h is None else dt.datetime(2024, 1, 2, h, tzinfo=dt.timezone.utc) for h in hours]
    return pa.RecordBatch.from_arrays([pa.array(t, pa.timestamp("us", tz="UTC")), pa.array([str(h) for h in hours])], names=["ts", "v"])


def test_archive_batches_enter_whole_or_not_at_all(spark, tmp_path):
    schema = "ts TIMESTAMP, v STRING"
    path = str(tmp_path / "archive")
    w = push.ArchiveWriter({"path": path, "writer": "w"})
    assert push.read_archive(spark, path, schema).count() == 0
    first = w.write(iter([batch(9, 10, None), batch(10)]))
    values = lambda: sorted(r.v for r in push.read_archive(spark, path, schema).collect())
    assert len(first.files) == 3 and values() == []  # written, not committed
    w.commit([first, None], 0)
    assert values() == ["10", "10", "9", "None"]
    again = w.write(iter([batch(9, 10, None), batch(10)]))
    w.commit([again], 0)  # the batch once more, after a restart
    assert values() == ["10", "10", "9", "None"] and not any(os.path.exists(f"{path}/{f}") for f in again.files)
    failed = w.write(iter([batch(11)]))
    w.abort([failed, None], 1)
    assert len(values()) == 4 and not any(os.path.exists(f"{path}/{f}") for f in failed.files)
    push.ArchiveWriter({"path": path, "writer": "other"}).commit([w.write(iter([batch(12)]))], 0)
    w.commit([w.write(iter([]))], 1)
    assert values() == ["10", "10", "12", "9", "None"]
    assert os.path.isdir(f"{path}/date=20240102/hour=10") and os.path.isdir(f"{path}/date=none/hour=none")
    with pytest.raises(ValueError, match="writer"):
        push.ArchiveWriter({"path": path})


def test_restart_reads_each_line_once_and_acknowledges(spark):
    from tandem.sources.shared import ship_package
    ship_package(spark)
    push.register(spark)
    path, out, checkpoint, ack = (fresh_path(spark, n) for n in ("landing", "out", "checkpoint", "ack"))
    os.makedirs(path)

    def run():
        s = spark.readStream.format("push_feed").option("path", path).option("ackPath", ack).option("reader", "t").load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.value for r in spark.read.schema(push.LINES).parquet(out).collect())

    def add(channel, text):
        with open(f"{path}/{channel}", "a") as f:
            f.write(text)
    add("a", "1\n2\n")
    assert run() == ["1", "2"]
    assert run() == ["1", "2"]
    add("a", "3\n4")
    add("b", "5\n")
    assert run() == ["1", "2", "3", "5"]
    add("a", "\n")
    assert run() == ["1", "2", "3", "4", "5"]
    with open(f"{ack}/t.json") as f:
        assert json.load(f)["a"] >= 6


def test_lines_that_are_no_json_give_nulls(spark):
    d = spark.createDataFrame([("c", 0, '{"code": "A", "price": 2.5}'), ("c", 30, "{broken")], push.LINES)
    rows = push.parsed(d, "code STRING, price DOUBLE").collect()
    assert [(r.position, r.code, r.price) for r in rows] == [(0, "A", 2.5), (30, None, None)]


def test_a_batch_writes_one_file_an_hour_however_it_is_split(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "archive")
    landing.mkdir()
    text = "".join(json.dumps({"ts": f"2024-01-02T{k % 5:02d}:00:00Z", "v": str(k)}) + "\n" for k in range(200))
    (landing / "one").write_text(text)
    push.register(spark)
    lines = spark.readStream.format("push_feed").option("path", str(landing)).option("splitBytes", 500).load()
    rows = push.by_hour(push.parsed(lines, "ts TIMESTAMP, v STRING").select("ts", "v"))
    w = rows.writeStream.format("push_archive").option("path", out).option("writer", "w").option("checkpointLocation", str(tmp_path / "checkpoint"))
    w.trigger(availableNow=True).start().awaitTermination()
    assert len(text) > 10 * 500 and len([f for _, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")]) == 5
    assert sorted(int(r.v) for r in push.read_archive(spark, out, "ts TIMESTAMP, v STRING").collect()) == list(range(200))
