"""Published option values and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import american as am, grids, pricing as pr
from tandem.functions.pricing import (implied_vol_european, norm_cdf, price_asian, price_european, price_spread_option,
                                      reject_reason)
from tandem.operators import options as op
from tandem.operators.options import mc_price_chain

COLS = "option_type string, fs double, x double, t double, r double, q double, v double"

# Fixed values: (type, spot, strike, time, rate, carry, volatility) -> value.
EUROPEAN = [
    ("c", 100, 95, 0.00273972602739726, 0.000751040922831883, 0, 0.2, 4.99998980469552),
    ("c", 92.45, 107.5, 0.0876712328767123, 0.00192960198828152, 0, 0.3, 0.162619795863781),
    ("c", 94.1166666666667, 107.75, 0.416438356164384, 0.00367360967852615, 0, 0.2919, 2.61731599547608),
    ("p", 94.2666666666667, 107.75, 0.498630136986301, 0.00372609838856132, 0, 0.2888, 16.6074587545269),
    ("p", 94.39, 107.75, 0.917808219178082, 0.00337464630758452, 0, 0.2876, 18.9397688539483),
    ("c", 100, 95, 1, 1, 0, 1, 14.6711476484), ("p", 100, 95, 1, 1, 0, 1, 12.8317504425),
    ("c", 100, 100, 100, 0.042033868311581, 0, 0.15, 0.817104022604705),
    ("c", 100, 0.01, 1, 0.00330252458693489, 0, 0.15, 99.660325245681),
    ("p", 100, 0.01, 1, 0.00330252458693489, 0, 0.15, 0),
    ("p", 100, 100, 1, 0.05, -1, 0.15, 60.1291675389721), ("c", 100, 100, 1, 0.05, 1, 0.15, 163.448023481557),
    ("c", 100, 100, 1, -1, 0, 0.15, 16.2513262267156), ("p", 100, 100, 1, 1, 0, 0.15, 2.19937783786316),
    ("c", 100, 100, 1, 0.05, 0, 0.005, 0.189742620249), ("c", 100, 100, 1, 0.05, 0, 1, 36.424945370234),
    ("c", 102, 100, 2, 0.05, 0.05, 0.25, 20.02128028), ("p", 102, 100, 2, 0.05, 0.05, 0.25, 8.50502208),
    ("c", 102, 100, 2, 0.05, 0.04, 0.25, 18.63371484), ("p", 102, 100, 2, 0.05, 0.04, 0.25, 9.13719197),
    ("c", 102, 100, 2, 0.05, 0, 0.25, 13.74803567), ("p", 102, 100, 2, 0.05, 0, 0.25, 11.93836083),
    ("c", 60, 65, 0.25, 0.08, 0.08, 0.30, 2.13336844492), ("p", 100, 95, 0.5, 0.10, 0.05, 0.20, 2.46478764676),
    ("c", 19, 19, 0.75, 0.10, 0, 0.28, 1.70105072524), ("c", 1.56, 1.60, 0.5, 0.06, -0.02, 0.12, 0.0290992531494),
]
AMERICAN = [
    ("p", 90, 100, 0.5, 0.1, 0, 0.15, 10.5400, 1e-3), ("p", 100, 100, 0.5, 0.1, 0, 0.25, 6.7661, 1e-3),
    ("p", 110, 100, 0.5, 0.1, 0, 0.35, 5.8374, 1e-3), ("c", 90, 100, 0.5, 0.1, 0, 0.15, 0.8099, 1e-3),
    ("c", 100, 100, 0.5, 0.1, 0, 0.25, 6.7661, 1e-3), ("c", 110, 100, 0.5, 0.1, 0, 0.35, 15.5137, 1e-3),
    ("c", 42, 40, 0.75, 0.04, -0.04, 0.35, 5.28, 1e-2), ("c", 90, 100, 0.1, 0.10, 0, 0.15, 0.02, 1e-2),
    ("c", 100, 100, 1, 0, 0, 0.35, 13.892, 1e-3), ("p", 100, 100, 1, 0, 0, 0.35, 13.892, 1e-3),
    ("c", 100, 100, 0.00396825396825397, 0.000771332656950173, 0, 0.15, 0.3769, 1e-3),
    ("c", 100, 100, 100, 0.042033868311581, 0, 0.15, 18.61206, 1e-3), ("p", 100, 100, 100, 0.042033868311581, 0, 0.15, 18.61206, 1e-3),
    ("c", 100, 0.01, 1, 0.00330252458693489, 0, 0.15, 99.99, 1e-3), ("p", 100, 0.01, 1, 0.00330252458693489, 0, 0.15, 0, 1e-3),
    ("p", 0.01, 100, 1, 0.00330252458693489, 0, 0.15, 99.99, 1e-3),
    ("p", 100, 100, 1, 0, -1, 0.15, 63.2121, 1e-3), ("c", 100, 100, 1, 0, 1, 0.15, 171.8282, 1e-3),
    ("c", 100, 100, 1, -1, 0, 0.15, 16.25133, 1e-3), ("c", 100, 100, 1, 1, 0, 0.15, 3.6014, 1e-3),
    ("c", 100, 100, 1, 0.05, 0, 0.005, 0.1916, 1e-3), ("p", 100, 100, 1, 0.05, 0, 1, 36.4860, 1e-3),
]


def chain(spark, rows):
    """Rows with carry b become rows with q = r - b."""
    return spark.createDataFrame([(k, float(f), float(x), float(t), float(r), float(r - b), float(v)) for k, f, x, t, r, b, v in rows], COLS)


def test_european_values(spark):
    got = price_european(chain(spark, [e[:7] for e in EUROPEAN]), "merton").toPandas()["value"]
    np.testing.assert_allclose(got, [e[7] for e in EUROPEAN], atol=1e-6)


def test_greeks(spark):
    one = lambda k, t, b, v: price_european(chain(spark, [(k, 100, 100, t, 0.05, b, v)])).first()
    c, p = one("c", 1, 0, 0.15), one("p", 1, 0, 0.15)
    assert c.delta == pytest.approx(0.50404947485, abs=1e-8) and p.delta == pytest.approx(-0.447179949651, abs=1e-8)
    assert c.gamma == pytest.approx(0.025227988795588, abs=1e-8) and c.theta == pytest.approx(-2.55380111351125, abs=1e-6)
    assert one("c", 2, 0.05, 0.25).vega == pytest.approx(50.7636345571413, abs=1e-6)
    assert c.rho == pytest.approx(44.7179949651117, abs=1e-6) and p.rho == pytest.approx(-50.4049474849597, abs=1e-6)


def test_put_call_parity(spark):
    rows = [(k, f, 100, 0.7, 0.03, 0.01, 0.3) for f in (80, 100, 125) for k in "cp"]
    d = price_european(chain(spark, rows)).toPandas()
    gap = d.value[d.option_type == "c"].to_numpy() - d.value[d.option_type == "p"].to_numpy()
    fwd = np.array([80, 100, 125]) * math.exp((0.01 - 0.03) * 0.7) - 100 * math.exp(-0.03 * 0.7)
    np.testing.assert_allclose(gap, fwd, atol=1e-9)


def test_asian_and_spread(spark):
    d = chain(spark, [("c", 102, 100, 2, 0.05, 0, 0.25), ("p", 102, 100, 2, 0.05, 0, 0.25)]).withColumn("t_a", F.lit(1.9))
    np.testing.assert_allclose(price_asian(d).toPandas()["value"], [13.53508930, 11.72541446], atol=1e-6)
    s = spark.createDataFrame([(k, 37.384913362, 42.1774, 3.0, 0.043055556, 0.0, 0.608063, 0.608063, 0.8) for k in "cp"],
                              "option_type string, f1 double, f2 double, x double, t double, r double, v1 double, v2 double, corr double")
    np.testing.assert_allclose(price_spread_option(s).toPandas()["value"], [0.007649192, 7.80013583], atol=1e-6)


def test_american_values(spark):
    d = am.price_american(chain(spark, [a[:7] for a in AMERICAN])).toPandas()["value"]
    for got, row in zip(d, AMERICAN):
        assert got == pytest.approx(row[7], abs=row[8]), row


def test_american_building_blocks():
    one = am.american([True] * 3, [90, 100, 110], 100, 0.5, 0.1, 0, [0.15, 0.25, 0.35], steps=1)
    np.testing.assert_allclose(one, [0.8089, 6.757, 15.4998], atol=1e-3)
    a, b, r = np.array([0, 0, -0.5, 0, 0, 0.5]), np.array([0, 0, 0, -0.5, 0, 0]), [0, -0.5, 0, 0, 0.5, 0]
    want = [0.25, 0.16666666666666669, 0.15426876936299347, 0.15426876936299347, 0.3333333333333333, 0.3457312306370065]
    for x, y, rho, w in zip(a, b, r, want):
        assert float(am.cdf2(np.array([x]), np.array([y]), rho)[0]) == pytest.approx(w, abs=1e-9)
    c = am._Call(*(np.array([v], float) for v in (120, 0, 3, 0.02, -0.03, 0.14)))
    assert c.phi(3.0, 4.51339343051624, 151.696096685711, 151.696096685711)[0] == pytest.approx(1102886677.05955, rel=1e-9)
    c = am._Call(*(np.array([v], float) for v in (125, 0, 3, 0.05, 0.03, 0.14)))
    assert c.phi(3.0, 1, 374.061664206768, 374.061664206768)[0] == pytest.approx(117.714544103477, abs=1e-6)


def test_american_is_never_below_european_and_iv_returns():
    rng = np.random.default_rng(1)
    n = 400
    call, fs, x = rng.random(n) < 0.5, rng.uniform(70, 130, n), np.full(n, 100.0)
    t, r, b, v = rng.uniform(0.05, 2, n), rng.uniform(0, 0.1, n), rng.uniform(-0.05, 0.1, n), rng.uniform(0.1, 0.6, n)
    value = am.american(call, fs, x, t, r, b, v)
    side = np.where(call, 1.0, -1.0)
    assert (value >= am.european(side, fs, x, t, r, b, v) - 1e-9).all()
    iv = am.american_iv(call, fs, x, t, r, b, value)
    again = am.american(call, fs, x, t, r, b, np.where(np.isnan(iv), v, iv))
    solved = ~np.isnan(iv)
    assert solved.mean() > 0.9 and np.abs(again - value)[solved].max() < 1e-5


def test_implied_vol_european(spark):
    rows = [e for e in EUROPEAN if 1e-2 < e[7] and e[6] in (0.3, 0.2919, 0.2888, 0.2876)]
    d = chain(spark, [e[:7] for e in rows]).toPandas()
    d["price"] = [e[7] for e in rows]
    got = implied_vol_european(spark.createDataFrame(d)).toPandas()
    np.testing.assert_allclose(got["iv"], got["v"], atol=1e-6)


def test_unreachable_price_has_no_iv(spark):
    d = chain(spark, [("c", 100, 100, 1, 0.0, 0.0, 0.2)]).withColumn("price", F.lit(150.0))
    assert implied_vol_european(d).first().iv is None


def test_reject_reasons(spark):
    rows = [("c", 100, 100, 1, 0.05, 0, 0.2), ("z", 100, 100, 1, 0.05, 0, 0.2), ("c", 100, 0, 1, 0.05, 0, 0.2),
            ("c", 0, 100, 1, 0.05, 0, 0.2), ("c", 100, 100, 0, 0.05, 0, 0.2), ("c", 100, 100, 1, 0.05, 2, 0.2),
            ("c", 100, 100, 1, 3, 0, 0.2), ("c", 100, 100, 1, 0.05, 0, 15)]
    got = [r.reason for r in chain(spark, rows).select(reject_reason().alias("reason")).collect()]
    assert got == [None, "option_type", "x", "fs", "t", "b", "r", "v"]


def test_monte_carlo_agrees(spark):
    d = chain(spark, [("c", 100, 105, 0.5, 0.03, 0.03, 0.25), ("p", 100, 105, 0.5, 0.03, 0.03, 0.25)]).withColumn("contract", F.col("option_type"))
    mc = {r.contract: r for r in mc_price_chain(d, 40_000).collect()}
    for r in price_european(d).collect():
        assert abs(mc[r.contract].value - r.value) < 4 * mc[r.contract].std_error


def test_norm_cdf_tails(spark):
    xs = [-40.0, -8.0, -1.0, 0.0, 1.0, 8.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf(F.col("x"))).collect()]
    np.testing.assert_allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rtol=1e-9, atol=1e-15)


def _legs(spark):
    rows = [("a", "c", 100.0, 1, 0, 0, 101.0, 0.5, 0.02, 0.0, 0.3), ("a", "p", 95.0, -1, 1, 1, 101.0, 0.5, 0.02, 0.01, 0.3),
            ("b", "p", 50.0, 1, 0, 0, 49.0, 0.1, 0.02, 0.0, 0.2), ("b", "c", None, 1, 0, 0, 48.0, 0.1, 0.02, 0.0, 0.2), (None, "c", 10.0, -1, 0, 1, 10.0, 1.0, 0.0, 0.0, 0.5),
            ("none", "c", 10.0, 1, 0, 0, 10.0, 1.0, 0.0, 0.0, None)]
    return spark.createDataFrame(rows, "k string, option_type string, x double, sign int, kept int, stock int, fs double, t double, r double, q double, v double")


def _plain_grid(legs, points, american):
    """By rows of (leg, step, point), added up by Spark."""
    price = am.price_american if american else pr.price_european
    d = price(legs).withColumnRenamed("value", "v0").select(*legs.columns, "v0").withColumnsRenamed({"fs": "fs0", "t": "t0"})
    d = d.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(4))))
    d = d.withColumn("fs", F.expr(f"fs0 * (0.9D + 0.2D * point / {points - 1})")).withColumn("t", F.expr("greatest(t0 * (1 - step / 4D), 0.01D)"))
    gain = F.expr("sign * (value - v0) + kept * v0 + stock * (fs - fs0)")
    return price(d).groupBy("k", "step", "point").agg(F.min("fs").alias("fs"), F.sum(gain).alias("pnl"))


def _summed(grid, keys, value, spot):
    won = f"{value} > 1e-9"
    return grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), *[F.expr(f"{f}({value})").alias(n) for f, n in (("max", "best"), ("min", "worst"), ("avg", "mean"))],
                                   F.expr(f"avg(CASE WHEN {won} THEN 1D ELSE 0D END)").alias("gains"), F.expr(f"max(CASE WHEN {won} THEN {spot} END)").alias("last_gain"),
                                   F.expr(f"min(CASE WHEN {won} THEN {spot} END)").alias("first_gain"))


def _equal(got, want, keys):
    by = lambda d: {tuple(r[k] for k in keys): r.asDict() for r in d.collect()}
    got, want = by(got), by(want)
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        assert row.keys() == got[k].keys()
        for c, x in row.items():
            assert got[k][c] == (pytest.approx(x, rel=1e-9, abs=1e-9) if isinstance(x, float) else x), (k, c)


@pytest.mark.parametrize("american", [False, True])
def test_scenario_grid_and_summary(spark, monkeypatch, american):
    monkeypatch.setattr(grids, "AT_ONCE", 7)
    legs, keys = _legs(spark).repartition(3), ["k", "step", "point"]
    want = _plain_grid(legs, 9, american).cache()
    _equal(op.scenario_grid(legs, ["k"], points=9, american=american), want, keys)
    _equal(op.scenario_summary(legs, ["k"], points=9, american=american), _summed(want, ["k", "step"], "pnl", "fs"), ["k", "step"])


def test_payoff_grid_and_summary(spark):
    legs = _legs(spark).withColumns({"premium": F.lit(2.0), "delta": F.when(F.col("k") != "a", 0.5), "scale": F.lit(2.0)})
    d = legs.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(30)))).withColumn("s", F.expr("fs * 0.8D + (fs * 1.2D - fs * 0.8D) * point / 30"))
    d = d.withColumn("i", F.expr("CASE WHEN option_type = 'c' THEN s - x ELSE x - s END"))
    gain = F.expr("sign * (CASE WHEN i < 0 THEN -premium ELSE i * delta - premium END) * scale + stock * (s - fs)")
    want = d.groupBy("k", "point").agg(F.min("s").alias("s"), F.sum(gain).alias("payoff")).cache()
    low, high = F.col("fs") * 0.8, F.col("fs") * 1.2
    _equal(op.payoff_grid(legs, ["k"], low, high, 31), want, ["k", "point"])
    _equal(op.payoff_summary(legs, ["k"], low, high, 31), _summed(want, ["k"], "payoff", "s"), ["k"])


def test_grid_points_are_not_moved(spark):
    """Only legs are shuffled: one exchange, below the grid, and no aggregation above it."""
    legs = _legs(spark).withColumns({"premium": F.lit(2.0), "delta": F.lit(0.5), "scale": F.lit(2.0)})
    low, high = F.col("fs") * 0.8, F.col("fs") * 1.2
    for d in (op.scenario_grid(legs, ["k"]), op.scenario_grid(legs, ["k"], american=True), op.scenario_summary(legs, ["k"]),
              op.payoff_grid(legs, ["k"], low, high), op.payoff_summary(legs, ["k"], low, high)):
        text = d._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and text.index("MapInArrow") < text.index("Aggregate") < text.index("Exchange")
