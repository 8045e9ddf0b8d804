"""Plan shapes that must hold at scale, and small semantic examples."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tandem.operators import clean, pairs, resample
from tandem.plans import feeds
from tandem.sources import bars as sb, models as sm

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_product(spark, sf_dir, name):
    if name.startswith(("r0", "r1", "s13", "s14", "a25_best", "a24_cluster", "op", "pipeline")):
        pytest.skip("runs jobs while it is built")
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_pushdown_and_pruning(spark, sf_dir):
    text = plan(QUERIES["c01_price_merton"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>", text)
    text = plan(QUERIES["e10_pct_vs_cost"](spark, sf_dir))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_resample_aggregates_before_the_shuffle(spark, sf_dir):
    text = plan(resample.resample_ticks(feeds.price_path(spark, sf_dir), "1 hour", units="units"))
    assert "partial_min_by" in text and "SortAggregate" not in text


def test_pair_moments_are_not_shuffled_by_row(spark, sf_dir):
    text = plan(QUERIES["a09_linreg"](spark, sf_dir))
    assert "partial_covar_pop" in text


def test_span_check_fails_short_tables(spark, sf_dir):
    b = feeds.bars(spark, sf_dir)
    assert clean.assert_span(b, 20).count() > 0
    with pytest.raises(Exception, match="span no more than 50 days"):
        clean.assert_span(b, 50).count()


def test_model_path(spark):
    d = spark.createDataFrame([("/a/2022-01-12.cn/ols.csv",), ("/b/2022-01-13.us_large/js_coint_v2.json",)], "path string")
    date, group = sm.model_path_key("path")
    assert [tuple(r) for r in d.select(date, group).collect()] == [("2022-01-12", "cn"), ("2022-01-13", "us_large")]
    with pytest.raises(Exception, match="not a model path"):
        spark.createDataFrame([("/a/b.csv",)], "path string").select(*sm.model_path_key("path")).collect()


def test_inventory_example(spark):
    names = ["999-AAPL-20090702-20190805-5m.csv", "998-GOOGL-20090702-20190805-5m.csv", "1000-ABNB-20110702-20120805-5m.csv",
             "1000-BZ-20110702-20120805-5m.csv", "1000-F-20000702-20000905-5m.csv", "README.csv"]
    inv = sb.parse_inventory(spark.createDataFrame([(n,) for n in names], "name string"))
    got = {(r.start, r.symbol): r.files for r in sb.group_inventory(inv).collect()}
    assert got == {("20090702", "AAPL"): 2, ("20090702", "GOOGL"): 2, ("20110702", "ABNB"): 2, ("20110702", "BZ"): 2, ("20000702", "F"): 1}
    universe = spark.createDataFrame([(s,) for s in ("AAPL", "ABNB", "GOOGL", "SPY", "QQQ")], "symbol string")
    assert {r.symbol for r in pairs.missing_symbols(universe, inv).collect()} == {"SPY", "QQQ"}


def test_inventory_scan_reads_only_the_listing(spark, tmp_path):
    for n in ("1-A-20200101-20200201-5m.csv", "2-B-20200101-20200201-5m.csv"):
        (tmp_path / n).write_text("x\n")
    assert {r.symbol for r in sb.scan_file_inventory(spark, str(tmp_path)).collect()} == {"A", "B"}


def test_shard_is_the_hash_modulus(spark):
    import hashlib
    names = ["AAPL", "MSFT", "BRK B", "700", "某"]
    d = spark.createDataFrame([(n,) for n in names], "s string")
    for shards in (20, 7):
        got = [r[0] for r in d.select(sb.shard_of(F.col("s"), shards)).collect()]
        assert got == [int(hashlib.sha1(n.encode()).hexdigest(), 16) % shards for n in names]


def test_wide_reader_on_the_usual_layout(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text(",AAA,AAA,BBB,BBB\n,close,volume,close,volume\ndate,,,,\n2022-01-03 09:30:00,1.5,10,2.5,20\n2022-01-03 09:31:00,1.6,11,,\n")
    got = sorted((r.symbol, r.ts, r.close, r.volume) for r in sb.read_bars_wide(spark, str(p)).where("close is not null").collect())
    assert got == [("AAA", dt.datetime(2022, 1, 3, 9, 30), 1.5, 10.0), ("AAA", dt.datetime(2022, 1, 3, 9, 31), 1.6, 11.0),
                   ("BBB", dt.datetime(2022, 1, 3, 9, 30), 2.5, 20.0)]
    assert sb.read_bars_wide(spark, str(p), drop_gaps=True).count() == 2


def test_universe_json(spark, tmp_path):
    p = tmp_path / "u.json"
    p.write_text('{"cn": "BABA, JD,,BRK/B ", "us": "AAPL,AAPL"}')
    got = {(r.grp, r.symbol) for r in sm.read_universe_json(spark, str(p)).collect()}
    assert got == {("cn", "BABA"), ("cn", "JD"), ("cn", "BRK B"), ("us", "AAPL")}


def test_pair_enumeration_with_one_big_group(spark):
    u = spark.createDataFrame([("g", f"S{k:03d}") for k in range(90)] + [("h", "X"), ("h", "Y")], "grp string, symbol string")
    p = pairs.enumerate_pairs(u, ["grp"])
    assert p.count() == 90 * 89 // 2 + 1 == p.select("grp", "pair").distinct().count()


def test_day_after_the_model_date(spark):
    days = ["2024-01-05 10:00:00", "2024-01-05 11:00:00", "2024-01-08 10:00:00", "2024-01-08 11:00:00", "2024-01-09 10:00:00"]
    b = spark.createDataFrame([("A", d) for d in days], "symbol string, t string").select("symbol", F.col("t").cast("timestamp_ntz").alias("ts"))
    m = spark.createDataFrame([("2024-01-05",), ("2024-01-06",), ("2024-01-09",)], "d string").select(F.col("d").cast("date").alias("model_date"))
    got = sorted((str(r.model_date), str(r.ts)) for r in clean.test_window(b, m).collect())
    assert got == [("2024-01-05", "2024-01-08 10:00:00"), ("2024-01-05", "2024-01-08 11:00:00"), ("2024-01-06", "2024-01-09 10:00:00")]
    r = {str(x.model_date): str(x.start_ts) for x in clean.bt_range(b, m).collect()}
    assert r == {"2024-01-05": "2024-01-08 10:00:00", "2024-01-06": "2024-01-08 10:00:00"}
    extra = clean.test_window(b, m, next_open=True).where("model_date = date'2024-01-05'").count()
    assert extra == 3


def test_wide_reader_fails_on_a_time_it_cannot_read(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text(",AAA,AAA\n,close,volume\ndate,,\n2022-01-03 09:30:00,1.5,10\nnot a time,1.6,11\n")
    with pytest.raises(Exception):
        sb.read_bars_wide(spark, str(p)).collect()


def test_the_price_path_is_summed_by_the_hour(spark, sf_dir, monkeypatch):
    """One task adds up the slices of a symbol: there is one an hour at most, however many ticks there are."""
    seen, running_sum = [], feeds.running_sum

    def watched(df, keys, order, slice_col, value, out):
        hours = (F.unix_seconds(F.max(F.col("ts").cast("timestamp"))) - F.unix_seconds(F.min(F.col("ts").cast("timestamp")))) / 3600
        seen.append(df.agg(F.max(slice_col) - F.min(slice_col), hours).first())
        return running_sum(df, keys, order, slice_col, value, out)
    monkeypatch.setattr(feeds, "running_sum", watched)
    feeds.price_path(spark, sf_dir)
    assert len(seen) == 1 and 0 < seen[0][0] <= seen[0][1] + 1
