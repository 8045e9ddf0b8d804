"""Cointegration, regression and half-life against direct computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.operators import cointegration as co, regression as rg


def walk(rng, n):
    return 100 + np.cumsum(rng.normal(size=n))


def panel_of(spark, series: dict, minutes=60):
    n = len(next(iter(series.values())))
    ts = pd.date_range("2024-01-01", periods=n, freq=f"{minutes}min")
    parts = [pd.DataFrame({"symbol": s, "ts": ts, "rn": np.arange(n, dtype="int64"), "close": v}) for s, v in series.items()]
    d = spark.createDataFrame(pd.concat(parts))
    return d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def adf_plain(x, constant):
    """ADF with explicit least squares for every lag."""
    n = len(x)
    top = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - int(constant) - 1)
    dx = np.diff(x)

    def fit(lag, skip):
        y = dx[skip:]
        cols = [x[skip:-1]] + [dx[skip - j:len(dx) - j] for j in range(1, lag + 1)]
        if constant:
            cols.append(np.ones(len(y)))
        a = np.column_stack(cols)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ beta
        return a, beta, e

    aic = []
    for lag in range(top + 1):
        a, _, e = fit(lag, top)
        aic.append(len(e) * math.log(e @ e / len(e)) + 2 * a.shape[1])
    a, beta, e = fit(int(np.argmin(aic)), int(np.argmin(aic)))
    s2 = e @ e / (len(e) - a.shape[1])
    return beta[0] / math.sqrt(s2 * np.linalg.inv(a.T @ a)[0, 0])


@pytest.mark.parametrize("constant", [False, True])
def test_adf_matches_plain_regressions(constant):
    rng = np.random.default_rng(3)
    for n in (60, 250, 900):
        x = walk(rng, n) - 100
        assert co.adf_t(x, constant) == pytest.approx(adf_plain(x, constant), rel=1e-8)


def test_engle_granger_tells_pairs_apart():
    rng = np.random.default_rng(5)
    x = walk(rng, 600)
    e = np.zeros(600)
    for k in range(1, 600):
        e[k] = 0.8 * e[k - 1] + rng.normal()
    y = 0.8 * x + 5 + e
    assert co.engle_granger_p(x, y) < 0.01
    p = [co.engle_granger_p(walk(rng, 300), walk(rng, 300)) for _ in range(200)]
    assert 0.02 < np.mean(np.array(p) < 0.05) < 0.12


def test_mackinnon_limits():
    assert co.mackinnon_p(5.0, 2) == 1.0 and co.mackinnon_p(-30.0, 2) == 0.0
    assert co.mackinnon_p(-3.34, 2) == pytest.approx(0.05, abs=0.01)
    assert co.mackinnon_p(-2.86, 1) == pytest.approx(0.05, abs=0.005)


def test_pearson_p_against_integration():
    r, n = 0.3, 40
    x = np.linspace(abs(r), 1, 400001)
    dens = (1 - x ** 2) ** ((n - 4) / 2)
    full = np.linspace(-1, 1, 800001)
    area = np.trapezoid((1 - full ** 2) ** ((n - 4) / 2), full)
    assert co.pearson_p(r, n) == pytest.approx(2 * np.trapezoid(dens, x) / area, rel=1e-5)


def test_johansen_moments_equal_matrix_route(spark):
    rng = np.random.default_rng(7)
    x = walk(rng, 500)
    y = 0.8 * x + 5 + rng.normal(size=500)
    z = walk(rng, 500)
    panel = panel_of(spark, {"A": x, "B": y, "C": z})
    got = {(r.n1, r.n2): r for r in co.johansen(panel, [60]).collect()}
    for pair, (a, b) in {("A", "B"): (x, y), ("A", "C"): (x, z), ("B", "C"): (y, z)}.items():
        values, vectors = co.johansen_matrix(np.column_stack([a, b]), 1)
        r = got[pair]
        np.testing.assert_allclose([r.lambda_0, r.lambda_1], values, rtol=1e-7)
        assert r.slope == pytest.approx(-vectors[0, 0] / vectors[1, 0], rel=1e-6)
        assert r.t == 498 and r.trace_0 == pytest.approx(-498 * np.log(1 - values).sum(), rel=1e-7)
    assert got["A", "B"].rank > 0 and got["A", "B"].slope == pytest.approx(0.8, abs=0.05)


def test_johansen_horizon_uses_only_its_rows(spark):
    rng = np.random.default_rng(8)
    x, y = walk(rng, 400), walk(rng, 400)
    r = co.johansen(panel_of(spark, {"A": x, "B": y}), [5]).first()
    part = np.column_stack([x, y])[-(5 * 24 + 1):]
    assert r.lambda_0 == pytest.approx(co.johansen_matrix(part, 1)[0][0], rel=1e-7)


def test_regression_statistics(spark):
    rng = np.random.default_rng(9)
    x = walk(rng, 400)
    e = np.zeros(400)
    for k in range(1, 400):
        e[k] = 0.9 * e[k - 1] + rng.normal()
    y = 1.5 * x + 3 + e
    r = rg.regress_all(panel_of(spark, {"A": x, "B": y})).first()
    s, i = np.polyfit(x, y, 1)
    res = s * x + i - y
    lag = np.concatenate([[res[0]], res[:-1]])
    step = np.concatenate([[res[1] - res[0]], np.diff(res)])
    hl = round(-math.log(2) / np.polyfit(lag, step, 1)[0], 2)
    ks = np.arange(2, 20)
    he = np.polyfit(np.log(ks), np.log([np.std(res[k:] - res[:-k]) for k in ks]), 1)[0]
    assert r.s == pytest.approx(s, rel=1e-8) and r.i == pytest.approx(i, rel=1e-6) and r.st == pytest.approx(res.std(ddof=1), rel=1e-8)
    assert r.halflife == pytest.approx(hl, abs=0.011) and r.he == pytest.approx(he, rel=1e-7)
    assert r.fast_s == pytest.approx((x * y).sum() / (x * x).sum(), rel=1e-9)
    assert 4 < r.halflife < 12  # -ln 2 / (0.9 - 1) = 6.9


def test_candidates_and_study(spark):
    rng = np.random.default_rng(11)
    n = 24 * 45
    x = walk(rng, n)
    y = 0.8 * x + 5 + rng.normal(size=n)
    panel = panel_of(spark, {"A": x, "B": y, "C": walk(rng, n)})
    c = {r.pair: r for r in co.coint_candidates(panel, (14, 28, 42)).collect()}
    assert c["A_B"].p < 0.01 and c["A_B"].pmin <= min(c["A_B"].p_14, c["A_B"].p_28, c["A_B"].p_42)
    assert c["A_B"].p_14 == pytest.approx(co.engle_granger_p(x[-(14 * 24 + 1):], y[-(14 * 24 + 1):]), abs=1e-12)
    study = co.coint_study(panel, days=(5, 7)).toPandas()
    assert set(zip(study.n1, study.n2)) >= {("A", "B")} and (study.p <= 0.05).all()
    # Every end date is the day after a trading day, found whatever the chunking.
    again = co.coint_study(panel, days=(5, 7), chunk_days=3).toPandas()
    key = ["n1", "n2", "d", "end"]
    pd.testing.assert_frame_equal(study.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))


def test_tests_from_moments_equal_tests_of_the_series(spark):
    """Also collinear legs, a constant leg, far levels, and horizons of a few rows."""
    rng = np.random.default_rng(21)
    n = 24 * 50
    x = walk(rng, n)
    series = {"A": x, "B": 0.8 * x + 5 + rng.normal(size=n), "C": 5000 + walk(rng, n), "D": 2 * x + 1, "E": np.full(n, 3.0)}
    panel = panel_of(spark, series).cache()
    for days in ((14, 28, 42), (0, 1, 49)):
        got = {r.pair: r for r in co.coint_candidates(panel, days).collect()}
        assert len(got) == 10
        for pair, r in got.items():
            a, b = pair.split("_")
            part = [(series[a][-(d * 24 + 1):], series[b][-(d * 24 + 1):]) for d in days]
            want = [co.engle_granger_p(*p) for p in part]
            have = [r[f"p_{d}"] for d in days]
            assert [v is None for v in have] == [math.isnan(v) for v in want]
            np.testing.assert_allclose([v for v in have if v is not None], [v for v in want if not math.isnan(v)], rtol=1e-8, atol=1e-10)
            known = {d: v for d, v in zip(days, have) if v is not None}
            d = min(known, key=lambda d: (known[d], days.index(d)))
            assert r.start_of_pmin == pd.Timestamp("2024-01-01") + pd.Timedelta(hours=n - 1 - d * 24)
    for r in co.pair_tests(panel).collect():
        a, b = series[r.n1], series[r.n2]
        for have, want in ((r.p_x, co.adf_p(a)), (r.p_y, co.adf_p(b)), (r.p_coint, co.engle_granger_p(a, b))):
            assert (have is None and math.isnan(want)) or have == pytest.approx(want, rel=1e-8, abs=1e-10)


def test_no_series_is_gathered_for_a_test(spark):
    rng = np.random.default_rng(2)
    plan = co.coint_candidates(panel_of(spark, {s: walk(rng, 300) for s in "ABC"}), (5, 10))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "partial_sum" in plan


def test_rolling_johansen_is_independent_of_chunks(spark):
    rng = np.random.default_rng(12)
    n = 24 * 30
    x = walk(rng, n)
    panel = panel_of(spark, {"A": x, "B": 0.8 * x + rng.normal(size=n)})
    run = lambda c: co.rolling_johansen(panel, days=(10,), step_hours=24, max_lag=4, chunk_days=c).toPandas().sort_values(["end", "lag"]).reset_index(drop=True)
    a, b = run(5), run(2)
    assert len(a) > 10
    pd.testing.assert_frame_equal(a, b)


def test_rolling_windows_equal_the_matrix_route(spark):
    """Twenty random windows at every lag, from the running sums and from the window's rows; no window ends in the last two days."""
    rng = np.random.default_rng(14)
    n = 24 * 6 * 26
    x = walk(rng, n)
    both = np.column_stack([x, 0.8 * x + 40 + np.cumsum(rng.normal(size=n)) * 0.05 + rng.normal(size=n)])
    panel = panel_of(spark, {"A": both[:, 0], "B": both[:, 1]}, minutes=10)
    got = co.rolling_johansen(panel, days=(10, 20), all_windows=True).toPandas()
    start = pd.Timestamp("2024-01-01")
    last = start + pd.Timedelta(minutes=10 * (n - 1))
    assert got["end"].max() == (last - pd.Timedelta(hours=48)).floor("h")
    assert len(got) == 7 * sum(int((got["end"].max() - start) / pd.Timedelta(hours=1)) - 24 * d + 1 for d in (10, 20))
    assert set(got.lag) == {1, 2, 4, 8, 16, 32, 64}
    for r in got.groupby("lag").sample(3, random_state=1).itertuples():
        end = int((r.end - start) / pd.Timedelta(minutes=10))
        values, vectors = co.johansen_matrix(both[end - r.days * 144:end + 1], r.lag)
        assert r.lambda_0 == pytest.approx(values[0], rel=1e-6)
        assert r.slope == pytest.approx(-vectors[0, 0] / vectors[1, 0], rel=1e-5)
        assert r.maxeig_0 == pytest.approx(-(r.days * 144 - r.lag) * math.log(1 - values[0]), rel=1e-6)


def test_a_leg_that_stands_still_has_no_rank(spark):
    rng = np.random.default_rng(15)
    n = 24 * 20
    got = co.rolling_johansen(panel_of(spark, {"A": walk(rng, n), "B": np.full(n, 7.0)}), days=(10,), max_lag=2, stop_hours=0)
    assert got.count() == 0


def hours_of(days, per_day=7):
    return pd.DatetimeIndex([d + pd.Timedelta(hours=9 + k) for d in days for k in range(per_day)])


def timed_panel(spark, times, series):
    rows = [(s, t.to_pydatetime(), float(v), k) for s, values in series.items() for k, (t, v) in enumerate(zip(times, values))]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, rn long")


def test_whole_series_is_tested(spark):
    """Seventy days: nothing older than some default is left out."""
    rng = np.random.default_rng(5)
    times = hours_of(pd.bdate_range("2024-01-01", periods=70), 6)
    x = walk(rng, len(times))
    y = 0.8 * x + rng.normal(size=len(times))
    panel = timed_panel(spark, times, {"A": x, "B": y})
    r = co.pair_tests(panel).first()
    assert r.corr == pytest.approx(np.corrcoef(x, y)[0, 1], rel=1e-9)
    assert r.p_coint == pytest.approx(co.engle_granger_p(x, y), abs=1e-12)
    m = {q.symbol: q for q in co.coint_matrix(co.pair_tests(panel), ["A", "B", "C"]).collect()}
    assert m["A"].A == 0 and m["A"].B == m["B"].A == r.p_coint and m["A"].C is None
    assert [(p.n1, p.n2) for p in co.coint_pairs(co.pair_tests(panel)).collect()] == [("A", "B")]


def test_end_dates_follow_trading_days(spark):
    """Business days from a Monday: the tenth is Friday the 12th, so the first end date for d = 5 is the 13th."""
    rng = np.random.default_rng(6)
    times = hours_of(pd.bdate_range("2024-01-01", periods=25))
    x = walk(rng, len(times))
    panel = timed_panel(spark, times, {"A": x, "B": x * 0.5 + rng.normal(size=len(times)) * 0.2})
    ends = sorted(r.end for r in co.coint_study(panel, days=(5,), max_p=1.0).collect())
    days = pd.bdate_range("2024-01-01", periods=25)
    assert ends == [(d + pd.Timedelta(days=1)).to_pydatetime() for d in days[9:]]


def test_windows_end_on_one_grid(spark):
    """A step of seven hours does not divide a chunk; one of 150 hours is longer than it."""
    rng = np.random.default_rng(13)
    n = 24 * 40
    x = walk(rng, n)
    panel = panel_of(spark, {"A": x, "B": 0.8 * x + rng.normal(size=n)})
    for step in (7, 150):
        got = co.rolling_johansen(panel, days=(10,), step_hours=step, max_lag=1).toPandas()
        hours = np.array([(e - pd.Timestamp(0)) / pd.Timedelta(hours=1) for e in got["end"]])
        assert len(hours) and (hours % step == 0).all()
    gaps = np.diff(np.sort(np.array([(e - pd.Timestamp(0)) / pd.Timedelta(hours=1) for e in
                                     co.rolling_johansen(panel, days=(10,), step_hours=7, max_lag=1).toPandas()["end"]])))
    assert (gaps % 7 == 0).all() and np.median(gaps) == 7


def test_no_p_from_too_few_rows():
    rng = np.random.default_rng(1)
    for n in range(0, 14):
        p = co.engle_granger_p(walk(rng, n), walk(rng, n)) if n else math.nan
        assert math.isnan(p) or 0 <= p <= 1


def test_symbols_without_common_bars_stay(spark):
    from tandem.operators import clusters as cl
    rows = [(s, pd.Timestamp("2024-01-01") + pd.Timedelta(days=k), k, *([100.0 + (k * (7 + i)) % 5] * 4))
            for i, s in enumerate("ABCD") for k in range(0 if s < "C" else 40, 40 if s < "C" else 80)]
    bars = spark.createDataFrame([(s, t.to_pydatetime(), rn, *v) for s, t, rn, *v in rows],
                                 "symbol string, ts timestamp_ntz, rn long, open double, high double, low double, close double")
    f = cl.return_features(bars)
    pdf = f.toPandas()
    got = {(r.a, r.b): r.d2 for r in cl.squared_distances(f).collect()}
    wide = {s: g.set_index("ts")[[f"r_{x}" for x in cl.FIELDS]] for s, g in pdf.groupby("symbol")}
    times = sorted(set(pdf["ts"]))
    full = {s: g.reindex(times).fillna(0).to_numpy() for s, g in wide.items()}
    assert set(got) == {(a, b) for a in "ABCD" for b in "ABCD" if a < b}
    assert all(d == pytest.approx(((full[a] - full[b]) ** 2).sum(), abs=1e-9) for (a, b), d in got.items())
    assert {r.symbol for r in cl.cluster_symbols(cl.squared_distances(f), 2).collect()} == set("ABCD")
