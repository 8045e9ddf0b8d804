"""Trade scans on hand-written sequences, features against a row-by-row recomputation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.operators import signals as sg, spreads as sp


def rows_of(spark, z, days=None, **more):
    n = len(z)
    base = pd.Timestamp("2024-01-02 09:30")
    ts = [base + pd.Timedelta(minutes=10 * k) + pd.Timedelta(days=(days[k] if days else 0)) for k in range(n)]
    d = pd.DataFrame({"n1": "A", "n2": "B", "ts": ts, "x": [100.0 + k for k in range(n)], "y": 50.0, "z": [float(v) for v in z], "s": 0.5, "st": 2.0})
    for k, v in more.items():
        d[k] = v
    out = spark.createDataFrame(d).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return out.withColumn("model_date", F.lit("2024-01-01").cast("date"))


def z_trades(spark, z, days=None):
    return sg.trades_z_trailing(rows_of(spark, z, days)).orderBy("z0").collect()


def test_entry_waits_for_the_turn_and_profit_closes(spark):
    # 2.5, 3 move outward (wait); 2.8 turns: sell first leg; 2.4, 1.5 come in (wait); 1.6 turns at 1.2 gain: close.
    (t,) = z_trades(spark, [1.0, 2.5, 3.0, 2.8, 2.4, 1.5, 1.6])
    assert t.z0 == 2.8 and t.z == 1.6 and t.stop == 0 and t.dz == pytest.approx(-1.2)
    # positions -100*s at 103 and +100 at 50, closed at 106: -150 over the larger leg 5150.
    assert t.rt == pytest.approx(-150 / 5150 * 100) and t.std_xy_percent == pytest.approx(200 / 103)


def test_stop_after_one_deviation(spark):
    (t,) = z_trades(spark, [-1.0, -3.0, -2.9, -3.95])
    assert t.z0 == -2.9 and t.z == -3.95 and t.stop == 1


def test_small_turn_keeps_the_position_and_open_trades_are_dropped(spark):
    assert z_trades(spark, [0.5, 2.6, 2.5, 2.2, 2.3, 2.25]) == []


def test_day_change_closes_and_ends(spark):
    (t,) = z_trades(spark, [0.5, 2.6, 2.5, 2.2, 5.0, 4.0, 1.0], days=[0, 0, 0, 0, 1, 1, 1])
    assert t.z == 5.0 and t.stop == 1


def test_no_entry_inside_the_band(spark):
    assert z_trades(spark, [1.9, 1.0, -1.9, -0.5, 2.0, 1.0]) == []


def v0(spark, z, halflife=7200, max_trades=1):
    d = rows_of(spark, z, p1=100.0, p2=50.0, slope=0.5, halflife_secs=halflife)
    return sg.trades_v0(d, max_trades).collect()


def test_v0_exits(spark):
    (t,) = v0(spark, [1.0, 2.6, 2.5, 1.0, 1.1])  # in by 1.5 at the bar before the turn
    assert t.reason == "profit" and t.tick_o == 3 and t.tick_c == 5
    (t,) = v0(spark, [1.0, 2.6, 2.5, 3.6])
    assert t.reason == "stop"
    (t,) = v0(spark, [1.0, 2.6, 2.5, 2.4, 2.3, 2.2], halflife=1200)
    assert t.reason == "timeout" and (t.tm_c - t.tm_o).total_seconds() == 1800
    (t,) = v0(spark, [1.0, 2.6, 2.5] + [2.5 - 0.01 * k for k in range(1, 20)], halflife=10 ** 6)
    assert t.reason == "force" and t.tick_c == 20  # first bar later than three hours
    assert v0(spark, [1.0, 2.6, 2.5, 1.0, 1.1, 2.6, 2.5, 1.0, 1.1])[0].tick_c == 5  # one trade at most


def base_row(**k):
    row = dict(diff=0.0, mean=0.0, std=1.0, stdH=1.0, stdL=0.5, em_var=4.0, z=0.0, zp1=0.0, zp2=0.0, zp3=0.0, p1=100.0, p2=50.0, slope=0.5,
               halflife_secs=3600, secs=1800, ts=pd.Timestamp("2024-01-02 10:00"), tick=1)
    return {**row, **k}


def test_v1_entry_gates():
    cross = dict(z=1.8, zp1=2.1, zp2=2.2, zp3=2.3)
    pos, _ = sg.step_v1(None, base_row(**cross), None)
    assert pos["side"] == 1 and pos["pos_x"] == -100 and pos["pos_y"] == 200 and pos["cap"] == pytest.approx(0.45)
    pos, _ = sg.step_v1(None, base_row(z=-1.8, zp1=-2.1, zp2=-2.2, zp3=-2.3), None)
    assert pos["side"] == -1 and pos["pos_x"] == 100 and pos["pos_y"] == -200
    for blocked in (dict(em_var=1e-4), dict(halflife_secs=17_000), dict(secs=600), dict(std=0.6), dict(zp2=2.05), dict(z=1.6), dict(zp1=1.95)):
        assert sg.step_v1(None, base_row(**{**cross, **blocked}), None) == (None, None), blocked


def test_v1_exits_in_order():
    open_ = dict(pos_x=-100, pos_y=200, x0=100.0, y0=50.0, tm_o=pd.Timestamp("2024-01-02 10:00"), tick_o=1, side=1, cap=-9.0,
                 crossed=[False] * 4, secs_o=1800)
    prev = base_row(diff=0.5, mean=1.0, std=0.2)
    pos, t = sg.step_v1(dict(open_), base_row(diff=0.4, secs=2400), prev)  # still falling: flags only
    assert t is None and pos["crossed"] == [False, True, True, True]
    # turning up: profit -100*(104-100) + 200*0 - 3 = -403
    _, t = sg.step_v1(dict(open_), base_row(diff=0.6, p1=104.0, secs=2400), prev)
    assert t["reason"] == "loss" and t["profit"] == pytest.approx(-403)
    _, t = sg.step_v1({**open_, "cap": 0.7}, base_row(diff=0.6, secs=2400), prev)
    assert t["reason"] == "cap"
    _, t = sg.step_v1(dict(open_), base_row(diff=0.6, secs=1800 + 7201), prev)
    assert t["reason"] == "timeout"
    again = base_row(diff=1.1, mean=1.0, std=0.2)
    _, t = sg.step_v1({**open_, "crossed": [False, False, False, True]}, base_row(diff=1.2, secs=2400), again)
    assert t["reason"] == "line"
    pos, t = sg.step_v1(dict(open_), base_row(diff=1.2, secs=2400), again)
    assert pos and t is None


def model_rows(n_hist=60, n_test=40, look=12, seed=3):
    rng = np.random.default_rng(seed)
    n = n_hist + n_test
    ts = pd.date_range("2024-01-01", periods=n, freq="10min")
    p1, p2 = 100 + np.cumsum(rng.normal(size=n)), 50 + np.cumsum(rng.normal(size=n))
    d = pd.DataFrame({"ts": ts, "rn": range(n), "p1": p1, "p2": p2, "diff": 0.5 * p1 - p2, "lookback": look, "end_ts": ts[n_hist - 1],
                      "model_start_ts": ts[10], "slope": 0.5, "halflife_secs": 1800})
    d["role"] = np.where(d.rn >= n_hist, 2, np.where(d.rn >= n_hist - look, 1, 0))
    return d


def test_features_against_plain_recursion():
    d = model_rows()
    look = 12
    got = sp.features_of(d).reset_index(drop=True)
    window, rows = [], d[d.role > 0].to_dict("records")
    state, out = None, []
    for k, r in enumerate(rows):
        x = r["diff"]
        if state is None:
            state = {w: (x, 0.0) for w in (12, 6, 5)}
        else:
            new = {}
            for w, (e, v) in state.items():
                lam = 2 / (1 + w)
                new[w] = (lam * x + (1 - lam) * e, (x - window[-1]) ** 2 if k == 1 else lam * (x - e) ** 2 + (1 - lam) * v)
            state = new
        window.append(x)
        last = window[-(look + 1):]
        if r["role"] == 2:
            out.append({"ema": state[12][0], "em_var": state[12][1], "ema_half": state[6][0], "ema_quarter": state[5][0], "em_var_5bars": state[5][1],
                        "mean": np.mean(last), "std": np.std(last, ddof=1), "mean_half": np.mean(last[-(len(last) // 2):]),
                        "z": (state[5][0] - state[12][0]) / math.sqrt(state[12][1]),
                        "avg_diffdiff": np.mean(np.abs(np.diff(window[-6:])))})
    ref = pd.DataFrame(out)
    for c in ref:
        np.testing.assert_allclose(got[c], ref[c], rtol=1e-9, err_msg=c)
    np.testing.assert_allclose(got.stdH, ref["std"].cummax())
    np.testing.assert_allclose(got.diffL, got["diff"].cummin())
    np.testing.assert_allclose(got.sm_std_5, ref["std"].rolling(5, min_periods=1).mean())
    span = (d.end_ts[0] - d.model_start_ts[0]).total_seconds()
    for k in (0, 20):
        t = got.ts[k]
        part = d[(d.ts <= t) & (d.ts >= t - pd.Timedelta(seconds=span))]["diff"]
        assert got.mean0[k] == pytest.approx(part.mean()) and got.std0[k] == pytest.approx(part.std())


def test_z_is_free_of_scale():
    d = model_rows()
    a = sp.features_of(d)["z"].to_numpy()
    b = sp.features_of(d.assign(diff=d["diff"] * 1000))["z"].to_numpy()
    np.testing.assert_allclose(a, b, rtol=1e-9)


def test_sizes_round_half_away(spark):
    assert sg.half_away(2.5) == 3 and sg.half_away(-2.5) == -3
    assert sg.open_legs(100.0, 50.0, 0.5, 1) == (-100, 200)
    assert sg.open_legs(100.0, 50.0, 0.7, -1) == (100, -143)  # first leg would cost more than the amount
    d = spark.createDataFrame([(100.0, 50.0, 0.5, 1), (100.0, 50.0, 0.7, -1), (33.3, 7.7, 1.9, 1)], "x double, y double, s double, d int")
    px, py = sp.size_pair(F.col("x"), F.col("y"), F.col("s"), F.col("d"))
    for r in d.select("*", px.alias("px"), py.alias("py")).collect():
        assert (r.px, r.py) == sg.open_legs(r.x, r.y, r.s, r.d)
