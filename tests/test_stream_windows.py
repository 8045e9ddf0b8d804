"""Interval joins, sessions and the late route over several micro-batches."""

import time

import pytest
from pyspark.sql import functions as F

from tandem.sources.shared import fresh_path
from tandem.streaming import feeds, windows as sw

T0 = 1_700_000_000


def at(secs):
    return F.timestamp_seconds(F.lit(T0) + secs)


def arrivals(spark, df, steps):
    """Stream of the rows' files, one a micro-batch, in the order of the steps."""
    path = fresh_path(spark, "steps")
    for step in steps:
        df.where(step).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, how="append"):
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, name), fresh_path(spark, name + "-checkpoint")
    with feeds._state_partitions(spark):
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(how)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q.recentProgress


@pytest.fixture(scope="module")
def sides(spark):
    quotes = spark.range(400).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"), at(F.col("id") * 60).alias("ts"), F.col("id").alias("q"))
    bars = spark.range(80).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("symbol"), at(F.col("id") * 300 + 7).alias("bar_ts"), F.col("id").alias("b"))
    want = quotes.join(bars.withColumnRenamed("symbol", "s"), F.expr("symbol = s AND bar_ts <= ts AND ts < bar_ts + INTERVAL 700 SECONDS")).select("q", "b")
    return quotes, bars, sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("first", ["quotes", "bars", "together"])
def test_interval_join_in_any_order_and_its_state_shrinks(spark, sides, first):
    quotes, bars, want = sides
    rows = quotes.select("symbol", "ts", "q", F.lit(None).cast("long").alias("b")).unionByName(bars.select("symbol", F.col("bar_ts").alias("ts"), F.lit(None).cast("long").alias("q"), "b"))
    parts = []
    for k in range(6):  # six stretches of time; in each, one side comes a micro-batch before the other
        stretch = (F.col("ts") >= at(F.lit(k * 4000))) & (F.col("ts") < at(F.lit((k + 1) * 4000)))
        sides_ = [stretch & F.col("q").isNotNull(), stretch & F.col("b").isNotNull()]
        parts += {"quotes": sides_, "bars": sides_[::-1], "together": [stretch]}[first]
    s = arrivals(spark, rows, parts)
    left = s.where("q is not null").select("symbol", "ts", "q")
    right = s.where("b is not null").select("symbol", F.col("ts").alias("bar_ts"), F.col("b"))
    got, progress = run(sw.interval_join(left, right, "symbol", 700, delay="5000 seconds").select("q", "b"), "ij")
    assert sorted(map(tuple, got.collect())) == want
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert sum(p["stateOperators"][0]["numRowsRemoved"] for p in progress if p["stateOperators"]) > 0
    assert kept[-1] < 400 and kept[-1] < max(kept) * 1.01  # less than all 400 + 2 * 80 rows, and not growing


def test_left_rows_without_partner(spark, sides):
    quotes, bars, want = sides
    few = bars.where("b % 10 = 0")
    matched = {q for q, b in want if b % 10 == 0}
    tail = quotes.select("symbol", at(F.lit(10 ** 6)).alias("ts"), F.lit(-1).cast("long").alias("q")).limit(1)
    left = arrivals(spark, quotes.unionByName(tail), [F.col("q") >= 0, F.col("q") < 0])
    end = few.select("symbol", at(F.lit(10 ** 6)).alias("bar_ts"), F.lit(-1).cast("long").alias("b")).limit(1)
    right = arrivals(spark, few.unionByName(end), [F.col("b") >= 0, F.col("b") < 0])
    got, _ = run(sw.interval_join(left, right, "symbol", 700, delay="0 seconds", how="leftOuter").select("q", "b"), "outer")
    alone = [r.q for r in got.where("b is null and q >= 0").collect()]
    assert sorted(alone) == sorted(set(range(400)) - matched)


def test_sessions_over_batches_use_each_symbols_gap(spark):
    d = spark.createDataFrame([("A", t, float(t)) for t in (0, 50, 100, 250, 300, 5000)] + [("B", t, float(t)) for t in (0, 150, 320, 5000)], "symbol string, t long, price double")
    d = d.select("symbol", at(F.col("t")).alias("ts"), "price", F.when(F.col("symbol") == "A", 100).otherwise(200).alias("gap"))
    s = arrivals(spark, d, [F.col("price").isin(50.0, 0.0, 320.0), F.col("price").isin(100.0, 150.0, 250.0, 300.0), F.col("price") == 5000.0])
    got, _ = run(sw.session_bars(s, "gap", "1000 seconds"), "sess")
    rows = sorted((r.symbol, r.n, r.open, r.close) for r in got.collect())
    assert rows == [("A", 2, 250.0, 300.0), ("A", 3, 0.0, 100.0), ("B", 3, 0.0, 320.0)]


def test_late_rows_have_their_own_table_and_a_repeated_batch_changes_nothing(spark):
    d = spark.range(300).select(F.lit("A").alias("symbol"), at(F.col("id") * 10).alias("ts"), F.col("id"))
    folder, checkpoint = fresh_path(spark, "route"), fresh_path(spark, "route-checkpoint")
    held = F.col("id") % 50 == 7
    stream = arrivals(spark, d, [~held & (F.col("id") < 150), ~held & (F.col("id") >= 150), held])
    route = sw.LateRoute(spark, folder, delay_secs=600)
    route.start(stream, checkpoint, availableNow=True).awaitTermination()
    want_late = [i for i in range(7, 300, 50) if i * 10 < 2990 - 600]

    def state():
        ids = lambda t: sorted(r.id for r in route.read(t, d.schema).collect())
        return ids("late"), ids("on_time")
    late, on_time = state()
    assert late == want_late and sorted(late + on_time) == list(range(300))
    route.write(d.where(held), 2)  # the last batch again, after its tables were written but before Spark noted it
    assert state() == (late, on_time)
    # a batch that failed between its two tables: the one in place stays, the other is written
    fresh = sw.LateRoute(spark, fresh_path(spark, "route"), delay_secs=600)
    fresh.write(d.where("id < 150"), 0)
    fresh._put(d.where("id >= 150"), "on_time", 1)
    fresh.write(d.where("id >= 150 or id = 3"), 1)
    assert sorted(r.id for r in fresh.read("late", d.schema).collect()) == [3]
    assert fresh.read("on_time", d.schema).count() == 300
    fresh.write(d.where("id = 4").withColumn("ts", F.lit(None).cast("timestamp")), 2)  # no time: never late, and the mark is carried on
    assert fresh._latest(2) == fresh._latest(1) and fresh.read("on_time", d.schema).count() == 301


def test_sessions_are_merged_before_the_shuffle(spark):
    """A busy key: its sessions reach the shuffle, not its rows."""
    ticks = spark.range(20_000).select(F.lit("A").alias("symbol"), at(F.col("id") / 10 + F.floor(F.col("id") / 5000) * 600).alias("ts"), F.col("id").cast("double").alias("price"), F.lit(60).alias("gap"))
    s = arrivals(spark, ticks, [F.lit(True)])
    out, checkpoint = fresh_path(spark, "merged"), fresh_path(spark, "merged-checkpoint")
    with feeds.sessions_by_split(spark), feeds._state_partitions(spark):
        bars = sw.session_bars(s, "gap", "1000 seconds")
        q = bars.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        plan = q._jsq.explainInternal(False)
    assert plan.rindex("MergingSessions") > plan.rindex("Exchange")
    got = spark.read.schema(bars.schema).parquet(out).collect()
    assert sorted((r.n, r.open, r.close) for r in got) == [(5000, 0.0, 4999.0), (5000, 5000.0, 9999.0), (5000, 10000.0, 14999.0)]
    assert spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition") == "false"


def test_a_step_comes_from_many_tasks_and_is_one_batch(spark):
    """Steps are written by the tasks that hold their rows; the route takes each step as a whole."""
    d = spark.range(0, 3000, 1, 8).select(F.lit("A").alias("symbol"), at(F.col("id") * 10).alias("ts"), F.col("id"))
    path, folder, checkpoint = (fresh_path(spark, n) for n in ("steps", "route", "route-checkpoint"))
    route, files = sw.LateRoute(spark, folder, delay_secs=600), []

    def arrived():
        table = spark.read.schema(d.schema).parquet(path)
        files.append(len(table.inputFiles()))
        route.start(spark.readStream.schema(d.schema).parquet(path), checkpoint, availableNow=True).awaitTermination()
    held = F.col("id") % 50 == 7
    sw.in_steps(d.repartition(8, "id"), path, [~held & (F.col("id") < 1500), ~held, F.lit(True)], arrived)
    assert files == [8, 16, 24]
    late = sorted(r.id for r in route.read("late", d.schema).collect())
    assert late == [i for i in range(7, 3000, 50) if i * 10 < 29990 - 600]
    assert sorted(late + [r.id for r in route.read("on_time", d.schema).collect()]) == list(range(3000))
    assert route._latest(2) is not None and route._latest(3) is None
