"""Sliced window computations against pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tandem.functions.quantiles as qt
from tandem.functions import ordered
from tandem.operators import aggregates as agg, asof, features as ft, volatility as vol


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    parts = []
    for s, n in (("hot", 900), ("b", 150), ("c", 40)):
        ts = pd.date_range("2024-01-01", periods=n, freq="7min") + pd.to_timedelta(rng.integers(0, 60, n), unit="s")
        close = 100 + np.cumsum(rng.normal(size=n))
        parts.append(pd.DataFrame({"symbol": s, "ts": ts, "close": close, "open": close + rng.normal(size=n) / 10}))
    d = pd.concat(parts).reset_index(drop=True)
    d["high"] = d[["open", "close"]].max(axis=1) + 0.1
    d["low"] = d[["open", "close"]].min(axis=1) - 0.1
    d["rn"] = d.groupby("symbol").cumcount()
    d["units"] = rng.integers(-50, 50, len(d))
    return d


@pytest.fixture(scope="module")
def bars(spark, series):
    return spark.createDataFrame(series.sample(frac=1, random_state=1)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_ROWS", 64)


def back(df, *cols):
    return df.select("symbol", "rn", *cols).toPandas().sort_values(["symbol", "rn"]).reset_index(drop=True)


def want(series, fn):
    return pd.concat([fn(g) for _, g in series.sort_values(["symbol", "rn"]).groupby("symbol")]).to_numpy()


def test_number_rows_and_running_sum(bars, series):
    d = bars.withColumn("_s", F.floor(F.col("rn") / 50)).withColumnRenamed("rn", "true_rn")
    d = ordered.number_rows(d, ["symbol"], ["ts"], "_s")
    assert d.where("rn <> true_rn").count() == 0
    d = ordered.running_sum(d, ["symbol"], ["ts"], "_s", "units", "total")
    np.testing.assert_array_equal(back(d, "total").total, want(series, lambda g: g.units.cumsum()))


def test_running_extremes_and_carry(bars, series):
    d = bars.withColumn("_s", F.floor(F.col("rn") / 50)).withColumn("v", F.when(F.col("units") > 40, F.col("units")))
    d = ordered.running_extremes(d, ["symbol"], ["rn"], "_s", {"top": ("close", "max"), "bottom": ("close", "min")})
    d = ordered.carry_forward(d, ["symbol"], ["rn"], "_s", "v", "seen")
    got = back(d, "top", "bottom", "seen")
    np.testing.assert_allclose(got.top, want(series, lambda g: g.close.cummax()))
    np.testing.assert_allclose(got.bottom, want(series, lambda g: g.close.cummin()))
    np.testing.assert_array_equal(got.seen.astype(float), want(series, lambda g: g.units.where(g.units > 40).ffill()))


def test_lags_cross_chunks(bars, series):
    got = back(ft.lagged(ft.lagged(bars, "close", 3, "b"), "close", -2, "a"), "b", "a")
    np.testing.assert_allclose(got.b, want(series, lambda g: g.close.shift(3)))
    np.testing.assert_allclose(got.a, want(series, lambda g: g.close.shift(-2)))


def test_moving_averages(bars, series):
    got = back(ft.ema(ft.sma(bars, [5, 80]), 14), "sma_5", "sma_80", "ema")
    np.testing.assert_allclose(got.sma_5, want(series, lambda g: g.close.rolling(5).mean()))
    np.testing.assert_allclose(got.sma_80, want(series, lambda g: g.close.rolling(80).mean()))

    def ema(g):
        x, e = g.close.to_numpy(), np.full(len(g), np.nan)
        e[13] = x[:14].mean()
        for k in range(14, len(x)):
            e[k] = x[k] * 2 / 15 + e[k - 1] * 13 / 15
        return pd.Series(e)

    np.testing.assert_allclose(got.ema, want(series, ema), rtol=1e-12)


@pytest.mark.parametrize("n", [2, 14, 200])
def test_atr(bars, series, n):
    def atr(g):
        h, l, c = (g[k].to_numpy() for k in ("high", "low", "close"))
        tr = np.maximum.reduce([h[1:] - l[1:], np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])])
        a = np.full(len(g), np.nan)
        if len(tr) >= n:
            a[n] = tr[:n].mean()
            for k in range(n, len(tr)):
                a[k + 1] = (a[k] * (n - 1) + tr[k]) / n
        return pd.Series(a)

    np.testing.assert_allclose(back(ft.atr(bars, n), "atr").atr, want(series, atr), rtol=1e-11)


def test_volatility_estimators(bars, series):
    w = 90
    d = vol.rolling_volatility(bars, {"w": w})
    got = back(d, "parkinson_w", "garman_klass_w", "yang_zhang_w", "ewma_w")

    def rows(fn):
        def run(g):
            out = np.full(len(g), np.nan)
            for k in range(w - 1, len(g)):
                out[k] = fn(g.iloc[k - w + 1:k])
            return pd.Series(out)
        return want(series, run)

    n = w - 1
    hl = lambda g: (np.log(g.high / g.low) ** 2).sum()
    np.testing.assert_allclose(got.parkinson_w, rows(lambda g: np.sqrt(hl(g) / (4 * n * np.log(2)))), rtol=1e-9)
    gk = lambda g: np.sqrt(max(hl(g) / 2 / n - (2 * np.log(2) - 1) * (np.log(g.close / g.close.shift()) ** 2).sum() / n, 0))
    np.testing.assert_allclose(got.garman_klass_w, rows(gk), rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(got.ewma_w, rows(lambda g: np.log(g.close / g.open).ewm(alpha=0.06, adjust=True).std().iloc[-1]), rtol=1e-8)

    def yz(g):
        rs = (np.log(g.high / g.close) * np.log(g.high / g.open) + np.log(g.low / g.close) * np.log(g.low / g.open)).sum() / n
        k = 0.34 / (1.34 + (n + 1) / (n - 1))
        return np.sqrt(np.log(g.open / g.open.shift()).var() + k * np.log(g.close / g.close.shift()).var() + (1 - k) * rs)

    np.testing.assert_allclose(got.yang_zhang_w, rows(yz), rtol=1e-8)


@pytest.mark.parametrize("rows", [40, 30_000])
def test_exact_quantiles(spark, rows):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=rows), np.full(rows // 2, 0.25)])  # a third of the rows are one value
    d = spark.createDataFrame(pd.DataFrame({"k": "x", "v": v})).repartition(8)
    qs = [0.0, 0.05, 0.25, 0.5, 0.61, 0.95, 1.0]
    got = {r.q: r.quantile for r in qt.exact_quantiles(d, ["k"], "v", qs).collect()}
    np.testing.assert_allclose([got[q] for q in qs], np.quantile(v, qs), rtol=1e-12, atol=1e-15)


def test_asof_example(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 5)], "symbol string, t int")
    right = spark.createDataFrame([("a", 2, 9.0), ("a", 3, 8.0)], "symbol string, t int, v double")
    ts = F.timestamp_add("SECOND", F.col("t"), F.lit("2024-01-01").cast("timestamp_ntz")).cast("timestamp_ntz").alias("ts")
    for secs in (1, 86_400):
        got = asof.asof_join(left.select("symbol", ts), right.select("symbol", ts, "v"), ["symbol"], ["v"], slice_secs=secs)
        assert [r.v for r in got.orderBy("ts").collect()] == [None, 8.0, 8.0]


def test_asof_matches_pandas(spark, series, bars):
    rng = np.random.default_rng(6)
    left = pd.DataFrame({"symbol": rng.choice(["hot", "b", "c"], 300), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 6 * 86400, 300), unit="s")})
    left["k"] = range(300)
    got = asof.asof_join(spark.createDataFrame(left).withColumn("ts", F.col("ts").cast("timestamp_ntz")), bars, ["symbol"], ["close"], slice_secs=3600)
    ref = pd.merge_asof(left.sort_values("ts"), series[["symbol", "ts", "close"]].sort_values("ts"), on="ts", by="symbol").sort_values("k")
    np.testing.assert_allclose(got.toPandas().sort_values("k").close, ref.close)


def test_rate_audit_example(spark):
    """The documented call sequence: times in seconds, and what is allowed then."""
    log = [(0.0, "c1", "s1"), (0.0, "c3", "s2"), (4.1, "c1", "s2"), (10.1, "c2", "s2"), (10.1, "c3", "s2"), (10.1, "c4", "s2")]
    asks = [(1.0, "c1", "s1", False), (1.0, "c1", "s2", True), (1.0, "c3", "s2", False), (1.0, "c4", "s2", True), (2.1, "c1", "s2", True),
            (4.1, "c1", "s1", True), (10.1, "c1", "s1", True)]
    ts = F.timestamp_add("MICROSECOND", (F.col("t") * 1_000_000).cast("bigint"), F.lit("2024-01-01").cast("timestamp_ntz")).cast("timestamp_ntz")
    for t, call, symbol, allowed in asks:
        before = [c for c in log if c[0] < t]
        rows = spark.createDataFrame(before + [(t, call, symbol)], "t double, call_name string, symbol string").withColumn("ts", ts)
        got = agg.call_rate_audit(rows, 8, 4, 3, 2, 2, 1).where(F.col("t") == t).first()
        assert got.allowed == allowed, (t, call, symbol)


def test_correlations_are_symmetric(spark, bars):
    c = agg.corr_matrix(bars.withColumn("ts", F.timestamp_add("MINUTE", F.col("rn").cast("bigint"), F.lit("2024-01-01").cast("timestamp_ntz"))).withColumn("r", F.col("close")))
    m = c.toPandas().pivot(index="a", columns="b", values="corr")
    np.testing.assert_allclose(m, m.T)
    np.testing.assert_allclose(np.diag(m), 1)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance,exact", [(None, True), (90, True), (90, False)])
def test_asof_match(spark, direction, tolerance, exact):
    """One key holds most rows on one day, which is cut into many slices; times are even seconds apart, so ties are equal times."""
    rng = np.random.default_rng(8)

    def rows(n, name):
        secs = np.concatenate([rng.choice(40_000, n, replace=False), 4 * 86_400 + rng.choice(900_000, n // 10, replace=False)])
        key = np.where(np.arange(len(secs)) % 8 == 7, "b", "hot")
        return pd.DataFrame({"symbol": key, "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(secs, unit="s"), name: np.arange(len(secs))}).sort_values("ts")

    left, right = rows(1500, "l"), rows(700, "r")
    want = pd.merge_asof(left, right.assign(rts=right.ts), on="ts", by="symbol", direction=direction, allow_exact_matches=exact,
                         tolerance=None if tolerance is None else pd.Timedelta(seconds=tolerance)).sort_values("l")
    ntz = lambda d: spark.createDataFrame(d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = asof.asof_match(ntz(left), ntz(right).withColumn("rts", F.col("ts")), ["symbol"], ["rts", "r"], direction, tolerance, exact, slice_rows=40)
    got = got.toPandas().sort_values("l")
    distance = lambda d: (d.rts - d.ts).abs().dt.total_seconds().to_numpy()
    np.testing.assert_array_equal(distance(got), distance(want))
    if direction != "nearest":
        np.testing.assert_array_equal(got.r.astype(float).to_numpy(), want.r.astype(float).to_numpy())


def test_asof_match_nulls_and_ties(spark):
    left = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 10:00:00', 1), ('a', NULL, 2), (NULL, TIMESTAMP_NTZ '2024-01-01 10:00:00', 3), "
                     "('z', TIMESTAMP_NTZ '2024-01-01 10:00:00', 4) AS t(symbol, ts, id)")
    right = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-01 10:00:00', 5), ('a', TIMESTAMP_NTZ '2024-01-01 10:00:00', 9), "
                      "('a', NULL, 7), (NULL, TIMESTAMP_NTZ '2024-01-01 10:00:00', 8) AS t(symbol, ts, v)")
    for direction, v in (("backward", 9), ("forward", 5), ("nearest", 9)):
        got = asof.asof_match(left, right, ["symbol"], ["v"], direction)
        assert {r.id: r.v for r in got.collect()} == {1: v, 2: None, 3: None, 4: None}
    assert asof.asof_match(left.limit(0), right, ["symbol"], ["v"]).count() == 0
    assert asof.asof_match(left, right.limit(0), ["symbol"], ["v"], "nearest").where("v is null").count() == 4
