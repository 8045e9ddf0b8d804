"""Streams give what the batch gives, however the input is cut."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.operators import signals as sg
from tandem.sources.shared import fresh_path
from tandem.operators.signals import V1
from tandem.operators.spreads import features_of
from tandem.streaming import feeds, quotes as sq
from tandem.streaming.signals import SpreadState, live_signals
from test_signals import model_rows

LIMITS = dict(min_std_rate=0.0, delay_secs=0, std_percent=0.0, session_secs=10 ** 7)


def write_steps(df, order, cuts, path):
    """Files that arrive one after another."""
    import time
    for k in range(len(cuts) - 1):
        df.where((F.col(order) >= cuts[k]) & (F.col(order) < cuts[k + 1])).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the file source orders by modification time


def signal_rows(spark):
    parts = []
    for k in range(12):
        d = model_rows(n_hist=150, n_test=120, look=100, seed=k).assign(n1="A", n2=f"B{k}")
        # Noise with two excursions, one each way, so that z leaves the bands and comes back.
        rng = np.random.default_rng(k)
        at = d.rn.to_numpy()
        bump = 5 * np.exp(-((at - 175) / 8) ** 2) - 5 * np.exp(-((at - 225) / 8) ** 2)
        d["diff"] = rng.normal(size=len(d)) * 0.5 + bump
        d["p1"], d["p2"] = (d["diff"] + 50) / 0.5, 50.0
        parts.append(d)
    rows = spark.createDataFrame(pd.concat(parts))
    for c in ("ts", "end_ts", "model_start_ts"):
        rows = rows.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return rows.withColumn("model_date", F.lit("2024-01-01").cast("date")).withColumn("halflife_secs", F.col("halflife_secs").cast("bigint"))


def run_signals(spark, rows, arrival, cuts, delay, end, idle_secs=10 ** 8, late=None, again=False):
    """Trades of a stream whose bars come in files by ``arrival``, and the last progress."""
    path, out, checkpoint = (fresh_path(spark, n) for n in ("rows", "signals", "checkpoint"))
    write_steps(rows.withColumn("_arrival", arrival), "_arrival", cuts, path)
    if again:  # a bar of the last file once more
        rows.withColumn("_arrival", F.lit(-1)).where("rn between 260 and 265").coalesce(1).write.mode("append").parquet(path)
    if late is not None:
        late.withColumn("_arrival", F.lit(-1)).coalesce(1).write.mode("append").parquet(path)
    shape = rows.withColumn("_arrival", arrival)
    feeds.heartbeat(shape, path, "ts", end, n1="", n2="", role=1, rn=0, diff=0.0, p1=1.0, p2=1.0, lookback=4, slope=1.0)
    stream = spark.readStream.schema(shape.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with feeds.rocks_state(spark), feeds._state_partitions(spark):
        q = (live_signals(stream, LIMITS, delay, idle_secs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(sg.LEG_TRADE).parquet(out).orderBy("n2", "tm_o").collect(), q.recentProgress, checkpoint


def same_trades(got, batch):
    assert [(r.n2, r.tm_o, r.tm_c, r.reason, r.tick_o, r.tick_c, r.pos_x, r.pos_y) for r in got] == [
        (r.n2, r.tm_o, r.tm_c, r.reason, r.tick_o, r.tick_c, r.pos_x, r.pos_y) for r in batch]
    for a, b in zip(got, batch):
        assert a.profit == pytest.approx(b.profit, rel=1e-9)


def test_signals_of_a_shuffled_stream_equal_the_batch_and_keep_constant_state(spark):
    rows = signal_rows(spark).cache()
    batch = sg.trades_v1(rows, LIMITS).orderBy("n2", "tm_o").collect()
    assert len(batch) >= 3
    last = rows.agg(F.max("ts")).first()[0]
    arrival = F.col("rn") + F.pmod(F.xxhash64("n2", "rn"), F.lit(30))  # up to 30 bars out of order
    got, progress, checkpoint = run_signals(spark, rows, arrival, [0, 160, 200, 240, 1000], "6 hours", last + dt.timedelta(hours=7), again=True)
    same_trades(got, batch)
    # what is left: one row and a ring of look + 1 spreads a model, and no waiting bars but the closing one
    keys = 12
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    assert state("model").count() == keys
    rings = state("ring").groupBy("key").count().collect()
    assert len(rings) == keys and {r["count"] for r in rings} == {101}
    assert state("waiting").count() <= 1


def test_late_bars_take_no_part_and_silent_models_are_closed(spark):
    rows = signal_rows(spark).where("n2 in ('B0', 'B1', 'B2')").cache()
    cut = rows.where("not (n2 = 'B1' and rn in (170, 171)) and (n2 != 'B2' or rn < 232)").cache()
    whole = {r.n2: r for r in sg.trades_v1(rows.where("n2 = 'B2'"), LIMITS).orderBy("tm_o").collect()}
    batch = sg.trades_v1(cut, LIMITS).orderBy("n2", "tm_o").collect()
    last = rows.agg(F.max("ts")).first()[0]
    late = rows.where("n2 = 'B1' and rn in (170, 171)")
    got, progress, checkpoint = run_signals(spark, cut, F.col("rn"), [0, 180, 230, 1000], "10 minutes", last + dt.timedelta(days=3), 86_400, late)
    same_trades([r for r in got if r.reason != "open"], batch)
    assert sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) == 2
    left = [r for r in got if r.reason == "open"]
    assert {r.n2 for r in left} <= {"B0", "B1", "B2"} and len(whole) <= 1
    assert spark.read.format("statestore").option("stateVarName", "ring").load(checkpoint).count() == 0


def test_stepped_features_equal_the_batch_features():
    d = model_rows(n_hist=90, n_test=400, look=33, seed=4).assign(n1="A", n2="B")
    want = features_of(d.copy()).reset_index(drop=True)
    state, seen = SpreadState(look=33), []
    for r in d[d.role > 0].sort_values("rn").to_dict("records"):
        state.step({**r, "us": int(r["ts"].value // 1000), "slope": 0.5, "halflife_secs": 1e9}, {**V1, **LIMITS})
        if r["role"] == 2:
            seen.append((state.ema[0], state.var[0], state.ema[1], state.var[2], state.prev[1], state.prev[2], state.std_high, state.std_low, state.z[0]))
            state = SpreadState.of(state.to_row(), list(state.ring))  # as it is stored
    names = ["ema", "em_var", "ema_half", "em_var_quarter", "mean", "std", "stdH", "stdL", "z"]
    np.testing.assert_allclose(np.array(seen), want[names].to_numpy(), rtol=1e-9, atol=1e-12)


def ticks(spark, n=600):
    d = spark.range(n).select(F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("symbol"),
                              F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37).alias("ts"),
                              (100 + F.sin(F.col("id").cast("double"))).alias("price"), F.lit(1).alias("size"))
    return d


def test_bars_in_steps_equal_one_batch_and_late_rows_are_dropped(spark):
    t = ticks(spark)
    path = fresh_path(spark, "ticks")
    cuts = [F.timestamp_seconds(F.lit(1_700_000_000 + s)) for s in (0, 7000, 15_000, 10 ** 6)]
    write_steps(t, "ts", cuts, path)
    late = t.limit(1).withColumn("price", F.lit(1.0))
    late.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = feeds.drain(sq.stream_bars(stream, "10 minutes", "5 minutes"), "bars").toPandas()
    assert got.low.min() > 90  # the late row belongs to a closed bar
    whole = t.groupBy("symbol", F.window("ts", "10 minutes").start.alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high")).toPandas()
    both = got.merge(whole, on=["symbol", "ts"])
    assert len(both) == len(got) > 30 and (both.high_x == both.high_y).all() and (both.volume == both.n).all()


def test_latest_quote_over_several_batches(spark):
    t = ticks(spark)
    path = fresh_path(spark, "ticks")
    write_steps(t, "ts", [F.timestamp_seconds(F.lit(1_700_000_000 + s)) for s in (0, 9000, 10 ** 6)], path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = feeds.drain_batches(sq.latest_quote(feeds.quote_fields(stream)), lambda d, _: d, "q").orderBy("symbol").collect()
    want = sq.latest_quote(feeds.quote_fields(t)).orderBy("symbol").collect()
    assert got == want


def test_duplicates_over_batches_are_dropped(spark):
    t = ticks(spark, 50).select("symbol", "ts", "price")
    path = fresh_path(spark, "dup")
    for _ in range(2):
        t.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)
    assert feeds.drain(sq.dedup_stream(stream), "dedup").count() == 50


def test_message_parsing(spark):
    m = spark.createDataFrame([('{"code": "A", "last_price": 3.5, "volume": 7}',)], "value string")
    r = feeds.parse_feed(m, "quote").first()
    assert (r.code, r.last_price, r.volume, r.open_price) == ("A", 3.5, 7.0, None)
