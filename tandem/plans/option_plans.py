"""Option-chain queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tandem.functions import american as am, pricing as pr
from tandem.operators import options as op, volatility as vol
from tandem.plans import feeds
from tandem.plans.feeds import CHAIN_SQL, panel_sql, with_
from tandem.plans.registry import query
from tandem.plans.window_plans import _GRID, _vol_sql


def cdf_sql(x: str) -> str:
    y = f"abs({x})"
    lit = lambda cs: [f"{c!r}e0" if "e" not in repr(c) else repr(c) for c in cs]
    def poly(cs):
        out = lit(cs)[0]
        for c in lit(cs)[1:]:
            out = f"({out} * {y} + {c})"
        return out
    bell = f"exp(-{y} * {y} / 2)"
    far = f"{bell} / (2.506628274631e0 * ({y} + 1 / ({y} + 2 / ({y} + 3 / ({y} + 4 / ({y} + 0.65e0))))))"
    tail = f"CASE WHEN {y} < 7.07106781186547e0 THEN {bell} * {poly(pr.HART_TOP)} / {poly(pr.HART_BOTTOM)} WHEN {y} <= 37 THEN {far} ELSE 0e0 END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def gbs_sql(source: str, b: str, name: str = "priced") -> str:
    """CTEs ``{name}`` with value and greeks for rows of ``source``."""
    return f""",
{name}_0 AS (SELECT *, {b} AS b_, CASE WHEN option_type = 'c' THEN 1e0 ELSE -1e0 END AS side FROM {source}),
{name}_1 AS (SELECT *, (ln(fs / x) + (b_ + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM {name}_0),
{name}_2 AS (SELECT *, side * d1 AS u1, side * (d1 - v * sqrt(t)) AS u2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS p1, exp((b_ - r) * t) AS carry, exp(-r * t) AS disc FROM {name}_1),
{name}_3 AS (SELECT *, {cdf_sql('u1')} AS c1, {cdf_sql('u2')} AS c2 FROM {name}_2),
{name} AS (SELECT *, side * (fs * carry * c1 - x * disc * c2) AS value, side * carry * c1 AS delta, carry * p1 / (fs * v * sqrt(t)) AS gamma,
  -(fs * v * carry * p1) / (2 * sqrt(t)) - side * (b_ - r) * fs * carry * c1 - side * r * x * disc * c2 AS theta, carry * fs * sqrt(t) * p1 AS vega,
  side * x * t * disc * c2 AS rho FROM {name}_3)"""


GREEKS = ["value", "delta", "gamma", "theta", "vega", "rho"]
GREEKS_SQL = ", ".join(f"round({g}, 7) + 0 AS {g}" for g in GREEKS)


def _greeks(d):
    return d.select("contract", *[F.round(g, 7).alias(g) for g in GREEKS])


@query("e11_norm_cdf", f"""
SELECT event_id, round({cdf_sql('z')}, 12) AS cdf, round(exp(-z * z / 2) / sqrt(2 * pi()), 12) AS pdf FROM (SELECT event_id, (value - 250) / 30 AS z FROM events)""")
def _(spark, sf):
    d = feeds.table(spark, sf, "events").select("event_id", ((F.col("value") - 250) / 30).alias("z"))
    return d.select("event_id", F.round(pr.norm_cdf(F.col("z")), 12).alias("cdf"), F.round(pr.norm_pdf(F.col("z")), 12).alias("pdf"))


def _european(name, model, b, extra_sql="", extra=None):
    @query(name, with_(CHAIN_SQL + extra_sql + gbs_sql("c2" if extra_sql else "chain", b), f"SELECT contract, {GREEKS_SQL} FROM priced"))
    def _(spark, sf):
        c = feeds.option_chain(spark, sf)
        return _greeks(pr.price_european(extra(c) if extra else c, model))


_european("c01_price_black_scholes", "black_scholes", "r")
_european("c01_price_merton", "merton", "r - q", """,
c2 AS (SELECT * REPLACE (0.001e0 * (p_partkey % 50) AS q) FROM chain)""",
          lambda c: c.withColumn("q", F.lit(0.001) * (F.col("p_partkey") % 50)))
_european("c01_price_black_76", "black_76", "0e0")
_european("c01_price_garman_kohlhagen", "garman_kohlhagen", "r - rf", """,
c2 AS (SELECT *, 0.002e0 * (p_partkey % 20) AS rf FROM chain)""",
          lambda c: c.withColumn("rf", F.lit(0.002) * (F.col("p_partkey") % 20)))


@query("c01_chain_with_spot_and_vol", with_(panel_sql() + _vol_sql({"w": 60}, 36.0) + """,
spot AS (SELECT symbol, arg_max(close, rn) / 10 AS fs FROM panel GROUP BY 1), hv AS (SELECT symbol, least(greatest(arg_max(garman_klass_w, rn), 0.005), 1) AS v FROM vol GROUP BY 1),
con AS (SELECT p_partkey || '-' || k AS contract, k AS option_type, p_retailprice / 10 AS x, (1 + p_size) / 52e0 AS t, 0.01e0 AS r, 0e0 AS q,
  list_extract((SELECT list(symbol ORDER BY symbol) FROM spot), 1 + p_partkey % 5) AS symbol FROM part, (VALUES ('c'), ('p')) o(k)),
chain AS (SELECT con.*, fs, v FROM con JOIN spot USING (symbol) JOIN hv USING (symbol))""" + gbs_sql("chain", "r - q"), """
SELECT contract, round(value, 5) + 0 AS value, round(delta, 5) + 0 AS delta FROM priced"""))
def _(spark, sf):
    p = feeds.panel(spark, sf)
    spot = p.groupBy("symbol").agg((F.max_by("close", "rn") / 10).alias("fs"))
    hv = vol.rolling_volatility(p, {"w": 60}, 36.0, ["garman_klass"]).groupBy("symbol").agg(
        F.least(F.greatest(F.max_by("garman_klass_w", "rn"), F.lit(0.005)), F.lit(1.0)).alias("v"))
    from tandem.operators.asof import universe_list
    names = F.array(*[F.lit(s) for s in universe_list(p)])
    c = feeds.option_chain(spark, sf).select(
        "contract", "option_type", (F.col("fs")).alias("x"), "t", "r", "q",
        F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("symbol"))
    d = pr.price_european(op.join_chain(c, spot, hv))
    return d.select("contract", F.round("value", 5).alias("value"), F.round("delta", 5).alias("delta"))


@query("c02_validate_chain", with_(CHAIN_SQL, """
, odd AS (SELECT contract, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE option_type END AS option_type, fs, x * (CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END) AS x,
  t * (p_partkey % 3) AS t, r + (CASE WHEN p_partkey % 13 = 0 THEN 1.5 ELSE 0 END) AS r, q, v * 2.5 AS v FROM chain)
SELECT contract, CASE WHEN option_type NOT IN ('c', 'p') THEN 'option_type' WHEN x < 0.01 OR x > 2147483248 THEN 'x' WHEN fs < 0.01 OR fs > 2147483248 THEN 'fs'
  WHEN t < 0.001 OR t > 100 THEN 't' WHEN r - q < -1 OR r - q > 1 THEN 'b' WHEN r < -1 OR r > 1 THEN 'r' WHEN v < 0.005 OR v > 1 THEN 'v' END AS reject_reason FROM odd"""))
def _(spark, sf):
    k = F.col("p_partkey")
    c = feeds.option_chain(spark, sf).withColumns({
        "option_type": F.when(k % 11 == 0, "x").otherwise(F.col("option_type")), "x": F.when(k % 7 == 0, 0.0).otherwise(F.col("x")),
        "t": F.col("t") * (k % 3), "r": F.col("r") + F.when(k % 13 == 0, 1.5).otherwise(0.0), "v": F.col("v") * 2.5})
    return op.validate_chain(c).select("contract", "reject_reason")


@query("c03_price_asian", with_(CHAIN_SQL, """
, a AS (SELECT *, t * 0.75 AS t_a, v * v AS v2 FROM chain),
c2 AS (SELECT * REPLACE (sqrt(ln((2 * exp(v2 * t) - 2 * exp(v2 * t_a) * (1 + v2 * (t - t_a))) / (v2 * v2 * (t - t_a) * (t - t_a))) / t) AS v) FROM a)""" + gbs_sql("c2", "0e0") + """
SELECT contract, round(value, 4) + 0 AS value FROM priced"""))
def _(spark, sf):
    c = feeds.option_chain(spark, sf).withColumn("t_a", F.col("t") * 0.75)
    return pr.price_asian(c).select("contract", F.round("value", 4).alias("value"))


@query("c03_price_spread", with_(CHAIN_SQL, """
, s AS (SELECT *, fs AS f1, x * 0.9 AS f2, x * 0.1 AS x9, v AS v1, v * 1.2 AS v2, 0.02e0 * (p_partkey % 45) AS corr FROM chain),
c2 AS (SELECT contract, option_type, f2 + x9 AS base, f1 / (f2 + x9) AS fs, 1e0 AS x, t, r,
  sqrt(v1 * v1 + pow(v2 * (f2 / (f2 + x9)), 2) - 2 * corr * v1 * v2 * (f2 / (f2 + x9))) AS v FROM s)""" + gbs_sql("c2", "0e0") + """
SELECT contract, round(value * base, 6) + 0 AS value FROM priced"""))
def _(spark, sf):
    c = feeds.option_chain(spark, sf)
    c = c.select("contract", "option_type", "t", "r", F.col("fs").alias("f1"), (F.col("x") * 0.9).alias("f2"), (F.col("x") * 0.1).alias("x"),
                 F.col("v").alias("v1"), (F.col("v") * 1.2).alias("v2"), (0.02 * (F.col("p_partkey") % 45)).alias("corr"))
    return pr.price_spread_option(c).select("contract", F.round("value", 6).alias("value"))


def spread_out(df):
    """Pricing costs far more than moving a row: use every core whatever the input's file layout."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def american_chain(spark, sf):
    """The chain with dividends, so that early exercise matters on both sides."""
    return spread_out(feeds.option_chain(spark, sf)).withColumns({"r": F.lit(0.04), "q": 0.002 * (F.col("p_partkey") % 40)})


AMERICAN_CHAIN_SQL = CHAIN_SQL + """,
achain AS (SELECT * REPLACE (0.04e0 AS r, 0.002e0 * (p_partkey % 40) AS q) FROM chain)"""


def american_sql(source: str, name: str = "amer", steps: int = 2) -> str:
    """CTEs that price ``source`` (carry r - q) with one or two exercise boundaries, value by value."""
    stages: list[str] = [f"""
{name}_s AS (SELECT *, CASE WHEN option_type = 'c' THEN fs ELSE x END AS s_, CASE WHEN option_type = 'c' THEN x ELSE fs END AS k_,
  CASE WHEN option_type = 'c' THEN r ELSE q END AS r_, CASE WHEN option_type = 'c' THEN r - q ELSE q - r END AS b_, v * v AS v2, 0.5e0 * (sqrt(5e0) - 1) * t AS t1 FROM {source})"""]
    last = [f"{name}_s"]

    def stage(cols: dict[str, str]) -> None:
        made = f"{name}_{len(stages)}"
        stages.append(f"{made} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {last[0]})")
        last[0] = made

    stage({"beta": "0.5e0 - b_ / v2 + sqrt(abs(pow(b_ / v2 - 0.5e0, 2) + 2 * r_ / v2))", "early": "b_ < r_"})
    stage({"hi_": "beta / (beta - 1) * k_", "lo_": "greatest(k_, CASE WHEN early THEN r_ / (r_ - b_) * k_ ELSE k_ END)"})
    scale = "k_ * k_ / ((hi_ - lo_) * lo_)" if steps == 2 else "lo_ / (hi_ - lo_)"
    edge = lambda t: f"lo_ + (hi_ - lo_) * (1 - exp(-(b_ * {t} + 2 * v * sqrt({t})) * {scale}))"
    stage({"near": edge("t1"), "far": edge("t")})
    rate = lambda p: f"(-r_ + {p} * b_ + 0.5e0 * {p} * ({p} - 1) * v2)"
    kap = lambda p: f"(2 * b_ / v2 + 2 * {p} - 1)"
    phis = {}  # (power, strike) of the first period
    span = "t1" if steps == 2 else "t"
    for p in ("beta", "1", "0"):
        for strike in (("far", "near") if steps == 2 else ("far", "k_")):
            phis[p, strike] = f"f{len(phis)}"
    if steps == 1:
        del phis["beta", "k_"]
    ds = {}
    for (p, strike), n in phis.items():
        ds[n + "d"] = f"-(ln(s_ / {strike}) + (b_ + ({p} - 0.5e0) * v2) * {span}) / (v * sqrt({span}))"
        ds[n + "e"] = f"-(ln(s_ / {strike}) + (b_ + ({p} - 0.5e0) * v2) * {span}) / (v * sqrt({span})) - 2 * ln(far / s_) / (v * sqrt({span}))"
    ds["e1"] = "(ln(s_ / k_) + (b_ + v2 / 2) * t) / (v * sqrt(t))"
    ds["e2"] = "(ln(s_ / k_) + (b_ - v2 / 2) * t) / (v * sqrt(t))"
    psis = {}
    if steps == 2:
        for p, strike in (("beta", "near"), ("1", "near"), ("1", "k_"), ("0", "near"), ("0", "k_")):
            n = psis[p, strike] = f"g{len(psis)}"
            drift, w1, w2 = f"(b_ + ({p} - 0.5e0) * v2)", "(v * sqrt(t1))", "(v * sqrt(t))"
            up, down = f"{drift} * t1", f"{drift} * t"
            firsts = [f"(ln(s_ / near) + {up})", f"(2 * ln(far) - ln(s_ * near) + {up})", f"(ln(s_ / near) - {up})", f"(2 * ln(far) - ln(s_ * near) - {up})"]
            seconds = [f"(ln(s_ / {strike}) + {down})", f"(2 * ln(far) - ln(s_ * {strike}) + {down})", f"(2 * ln(near) - ln(s_ * {strike}) + {down})",
                       f"(ln(s_ / {strike}) + 2 * ln(near / far) + {down})"]
            for j in range(4):
                ds[f"{n}a{j}"] = f"greatest(least(-{firsts[j]} / {w1}, 38), -38)"
                ds[f"{n}b{j}"] = f"greatest(least(-{seconds[j]} / {w2}, 38), -38)"
    stage(ds)
    stage({"n_" + c: cdf_sql(c) for c in ds})
    cols = {}
    for (p, strike), n in phis.items():
        grow = f"{rate(p)} * {span} + {p} * ln(s_)"
        cols[n] = f"exp({grow}) * n_{n}d - exp({grow} + {kap(p)} * ln(far / s_)) * n_{n}e"
    if steps == 2:
        def both(a, b, sign):
            top = np.arcsin(sign * np.sqrt(am.GOLDEN))
            angle = top * (am._NODES + 1) / 2
            term = lambda s, c, w: f"{float(w)!r}::DOUBLE * exp(-({a} * {a} + {b} * {b} - 2 * {a} * {b} * {float(s)!r}::DOUBLE) / {float(2 * c)!r}::DOUBLE)"
            total = " + ".join(term(s, c, w) for s, c, w in zip(np.sin(angle), np.cos(angle) ** 2, am._WEIGHTS))
            return f"(n_{a} * n_{b} + ({total}) * {float(top / 4 / np.pi)!r}::DOUBLE)"
        weights = lambda p: ["0", f"{kap(p)} * ln(far / s_)", f"{kap(p)} * ln(near / s_)", f"{kap(p)} * ln(near / far)"]
        for (p, strike), n in psis.items():
            grow = f"{rate(p)} * t + {p} * ln(s_)"
            legs = [(1, 1), (-1, 1), (-1, -1), (1, -1)]
            cols[n] = " + ".join(f"{sg} * exp({grow} + {weights(p)[j]}) * {both(f'{n}a{j}', f'{n}b{j}', rho)}" for j, (sg, rho) in enumerate(legs))
    cols["euro"] = "s_ * exp((b_ - r_) * t) * n_e1 - k_ * exp(-r_ * t) * n_e2"
    stage(cols)
    f = lambda p, k: phis[p, k]
    if steps == 2:
        g = lambda p, k: psis[p, k]
        held = (f"(far - k_) * pow(far, -beta) * (pow(s_, beta) - {f('beta', 'far')}) + {f('1', 'far')} - {f('1', 'near')} + (near - k_) * pow(near, -beta) * ({f('beta', 'near')} - {g('beta', 'near')})"
                f" + {g('1', 'near')} - {g('1', 'k_')} + k_ * ({f('0', 'near')} - {f('0', 'far')} + {g('0', 'k_')} - {g('0', 'near')})")
    else:
        held = (f"(far - k_) * pow(far, -beta) * (pow(s_, beta) - {f('beta', 'far')}) + {f('1', 'far')} - {f('1', 'k_')} - k_ * ({f('0', 'far')} - {f('0', 'k_')})")
    stages.append(f"{name} AS (SELECT *, CASE WHEN early THEN greatest(CASE WHEN s_ >= far THEN s_ - k_ ELSE {held} END, euro) ELSE euro END AS value FROM {last[0]})")
    return "," + ",\n".join(stages)


@query("c04_price_american", with_(AMERICAN_CHAIN_SQL + american_sql("achain"), "SELECT contract, round(value, 5) + 0 AS value FROM amer"))
def _(spark, sf):
    d = am.price_american(american_chain(spark, sf))
    return d.select("contract", F.round("value", 5).alias("value"))


@query("c04_price_american_1993", with_(AMERICAN_CHAIN_SQL + american_sql("achain", steps=1), "SELECT contract, round(value, 5) + 0 AS value FROM amer"))
def _(spark, sf):
    d = am.price_american(american_chain(spark, sf), steps=1)
    return d.select("contract", F.round("value", 5).alias("value"))


@query("c05_implied_vol_european", with_(CHAIN_SQL + gbs_sql("chain", "r - q"), """
SELECT contract, round(value, 5) + 0 AS value, CASE WHEN vega > 2 THEN round(v, 5) END AS iv FROM priced"""))
def _(spark, sf):
    c = pr.price_european(spread_out(feeds.option_chain(spark, sf))).withColumnRenamed("value", "price").drop("delta", "gamma", "theta", "rho")
    d = pr.implied_vol_european(c)
    again = pr.price_european(d.withColumn("v", F.col("iv")).withColumnRenamed("vega", "_vega"))
    return again.select("contract", F.round("value", 5).alias("value"), F.when(F.col("_vega") > 2, F.round("iv", 5)).alias("iv"))


@query("c05_implied_vol_american", with_(AMERICAN_CHAIN_SQL + american_sql("achain"), """
SELECT contract, round(value, 5) + 0 AS price, true AS reprices FROM amer"""))
def _(spark, sf):
    c = am.price_american(american_chain(spark, sf), out="price")
    d = am.price_american(am.implied_vol_american(c).withColumn("v", F.col("iv")), out="again")
    return d.select("contract", F.round("price", 5).alias("price"), (F.col("iv").isNull() | (F.abs(F.col("again") - F.col("price")) < 1e-5)).alias("reprices"))


@query("c06_mc_price_chain")
def _(spark, sf):
    return op.mc_price_chain(spread_out(feeds.option_chain(spark, sf)), paths=500)


STRUCT_SQL = """
base AS (SELECT p_partkey, p_retailprice / 10 AS fs, (1 + p_size) / 52e0 AS t, 0.01e0 AS r, 0e0 AS q, 0.1e0 + 0.01e0 * (p_partkey % 40) AS v FROM part),
legs AS (SELECT p_partkey, structure, option_type, fs * k AS x, sign, kept, stock, fs, t, r, q, v FROM base,
  (VALUES ('bull_put', 'p', 0.95e0, 1, 0, 0), ('bull_put', 'p', 0.98e0, -1, 0, 0), ('condor', 'p', 0.95e0, 1, 0, 1), ('condor', 'p', 0.98e0, -1, 0, 0),
   ('condor', 'c', 1.05e0, -1, 0, 0), ('covered', 'c', 1.05e0, -1, 1, 1)) l(structure, option_type, k, sign, kept, stock))"""


def structures(spark, sf):
    """Bull put spread, condor with stock, and covered call on every part."""
    legs = [("bull_put", "p", 0.95, 1, 0, 0), ("bull_put", "p", 0.98, -1, 0, 0), ("condor", "p", 0.95, 1, 0, 1),
            ("condor", "p", 0.98, -1, 0, 0), ("condor", "c", 1.05, -1, 0, 0), ("covered", "c", 1.05, -1, 1, 1)]
    names = ("structure", "option_type", "k", "sign", "kept", "stock")
    leg = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in legs])).alias("_l")
    p = feeds.table(spark, sf, "part")
    base = p.select("p_partkey", (F.col("p_retailprice") / 10).alias("fs"), ((1 + F.col("p_size")) / F.lit(52.0)).alias("t"), F.lit(0.01).alias("r"),
                    F.lit(0.0).alias("q"), (F.lit(0.1) + F.lit(0.01) * (F.col("p_partkey") % 40)).alias("v"), leg)
    return base.select("p_partkey", "_l.structure", "_l.option_type", (F.col("fs") * F.col("_l.k")).alias("x"), "_l.sign", "_l.kept", "_l.stock",
                       "fs", "t", "r", "q", "v")


@query("c07_scenario_grid", with_(STRUCT_SQL + gbs_sql("legs", "r - q", "open_") + """,
grid AS (SELECT p_partkey, structure, option_type, x, sign, kept, stock, r, q, v, value AS v0, fs AS fs0, fs * (0.9e0 + 0.2e0 * point / 10) AS fs,
  greatest(t * (1 - step / 4e0), 0.01e0) AS t, point, step FROM open_, generate_series(0, 10) p(point), generate_series(1, 4) s(step))""" + gbs_sql("grid", "r - q") + """
SELECT p_partkey, structure, CAST(step AS INTEGER) AS step, CAST(point AS INTEGER) AS point, round(sum(sign * (value - v0) + kept * v0 + stock * (fs - fs0)), 6) + 0 AS pnl
FROM priced GROUP BY 1, 2, 3, 4"""))
def _(spark, sf):
    d = op.scenario_grid(structures(spark, sf), ["p_partkey", "structure"], points=11)
    return d.select("p_partkey", "structure", "step", "point", F.round("pnl", 6).alias("pnl"))


@query("c07_scenario_grid_american", with_(STRUCT_SQL + american_sql("legs", "open_") + """,
grid AS (SELECT p_partkey, structure, option_type, x, sign, kept, stock, r, q, v, value AS v0, fs AS fs0, fs * (0.9e0 + 0.2e0 * point / 4) AS fs,
  greatest(t * (1 - step / 4e0), 0.01e0) AS t, point, step FROM open_, generate_series(0, 4) p(point), generate_series(1, 4) s(step))""" + american_sql("grid") + """
SELECT p_partkey, structure, CAST(step AS INTEGER) AS step, CAST(point AS INTEGER) AS point, round(sum(sign * (value - v0) + kept * v0 + stock * (fs - fs0)), 5) + 0 AS pnl
FROM amer GROUP BY 1, 2, 3, 4"""))
def _(spark, sf):
    d = op.scenario_grid(structures(spark, sf), ["p_partkey", "structure"], points=5, american=True)
    return d.select("p_partkey", "structure", "step", "point", F.round("pnl", 5).alias("pnl"))


@query("c07_strike_premium_curve", with_(CHAIN_SQL + """,
curve AS (SELECT contract, option_type, fs, fs * 0.7e0 + (fs * 1.3e0 - fs * 0.7e0) * point / 20 AS x, t, r, q, v, point FROM chain, generate_series(0, 20) g(point))""" + gbs_sql("curve", "r - q") + """
SELECT contract, CAST(point AS INTEGER) AS point, round(value, 6) + 0 AS value, round(delta, 6) + 0 AS delta FROM priced"""))
def _(spark, sf):
    d = op.premium_curve(spread_out(feeds.option_chain(spark, sf)), "x", F.col("fs") * 0.7, F.col("fs") * 1.3, 21)
    return d.select("contract", "point", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


@query("c07_vol_premium_curve", with_(CHAIN_SQL + """,
curve AS (SELECT contract, option_type, fs, x, t, r, q, 0.01e0 + (0.5e0 - 0.01e0) * point / 10 AS v, point FROM chain, generate_series(0, 10) g(point))""" + gbs_sql("curve", "r - q") + """
SELECT contract, CAST(point AS INTEGER) AS point, round(value, 6) + 0 AS value FROM priced"""))
def _(spark, sf):
    d = op.premium_curve(spread_out(feeds.option_chain(spark, sf)), "v", F.lit(0.01), F.lit(0.5), 11)
    return d.select("contract", "point", F.round("value", 6).alias("value"))


PAYOFF_SQL = """
WITH base AS (SELECT p_partkey, p_retailprice / 10 AS fs FROM part),
legs AS (SELECT p_partkey, structure, option_type, fs * k AS x, premium, delta, sign, scale, stock, fs FROM base, (VALUES ('condor', 'p', 0.93e0, 30e0, 0.2e0, 1, 1e0, 0),
  ('condor', 'p', 0.95e0, 35e0, 0.3e0, -1, 1e0, 0), ('condor', 'c', 1.05e0, 30e0, 0.3e0, -1, 1e0, 0), ('condor', 'c', 1.07e0, 20e0, 0.2e0, 1, 1e0, 0),
  ('covered', 'c', 1.01e0, 2.07e0, 0.5e0, -1, 2e0, 1)) l(structure, option_type, k, premium, delta, sign, scale, stock)),
g AS (SELECT *, fs * 0.8e0 + (fs * 1.2e0 - fs * 0.8e0) * point / {last} AS s FROM legs, generate_series(0, {last}) g(point)),
i AS (SELECT *, CASE WHEN option_type = 'c' THEN s - x ELSE x - s END AS i FROM g)"""


@query("c08_payoff_grid", PAYOFF_SQL.format(last=24) + """
SELECT p_partkey, structure, CAST(point AS INTEGER) AS point, round(sum(sign * (CASE WHEN i < 0 THEN -premium ELSE i * delta - premium END) * scale + stock * (s - fs)), 8) + 0 AS payoff
FROM i GROUP BY 1, 2, 3""")
def _(spark, sf):
    got = op.payoff_grid(payoff_legs(spark, sf), ["p_partkey", "structure"], F.col("fs") * 0.8, F.col("fs") * 1.2, 25)
    return got.select("p_partkey", "structure", "point", F.round("payoff", 8).alias("payoff"))


SUMMARY_SQL = """count(*) AS points, round(max({v}), {n}) + 0 AS best, round(min({v}), {n}) + 0 AS worst, round(avg({v}), {n}) + 0 AS mean,
  round(avg(CASE WHEN {v} > 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS gains, round(max(CASE WHEN {v} > 1e-9 THEN {s} END), 6) AS last_gain,
  round(min(CASE WHEN {v} > 1e-9 THEN {s} END), 6) AS first_gain"""


def _summary(d, keys, n):
    return d.select(*keys, "points", *[(F.round(c, n) + 0).alias(c) for c in ("best", "worst", "mean")], *[F.round(c, 6).alias(c) for c in ("gains", "last_gain", "first_gain")])


# The whole grid of 200 spots and four steps, and of 1000 spots, told by its extremes.
@query("c07_scenario_extremes", with_(STRUCT_SQL + gbs_sql("legs", "r - q", "open_") + """,
grid AS (SELECT p_partkey, structure, option_type, x, sign, kept, stock, r, q, v, value AS v0, fs AS fs0, fs * (0.9e0 + 0.2e0 * point / 199) AS fs,
  greatest(t * (1 - step / 4e0), 0.01e0) AS t, point, step FROM open_, generate_series(0, 199) p(point), generate_series(1, 4) s(step))""" + gbs_sql("grid", "r - q") + """,
pnl AS (SELECT p_partkey, structure, step, point, min(fs) AS fs, sum(sign * (value - v0) + kept * v0 + stock * (fs - fs0)) AS pnl FROM priced GROUP BY 1, 2, 3, 4)
SELECT p_partkey, structure, CAST(step AS INTEGER) AS step, """ + SUMMARY_SQL.format(v="pnl", s="fs", n=5) + " FROM pnl GROUP BY 1, 2, 3"))
def _(spark, sf):
    return _summary(op.scenario_summary(structures(spark, sf), ["p_partkey", "structure"]), ["p_partkey", "structure", "step"], 5)


def payoff_legs(spark, sf):
    legs = [("condor", "p", 0.93, 30.0, 0.2, 1, 1.0, 0), ("condor", "p", 0.95, 35.0, 0.3, -1, 1.0, 0), ("condor", "c", 1.05, 30.0, 0.3, -1, 1.0, 0),
            ("condor", "c", 1.07, 20.0, 0.2, 1, 1.0, 0), ("covered", "c", 1.01, 2.07, 0.5, -1, 2.0, 1)]
    names = ("structure", "option_type", "k", "premium", "delta", "sign", "scale", "stock")
    leg = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in legs])).alias("_l")
    d = feeds.table(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") / 10).alias("fs"), leg)
    return d.select("p_partkey", "fs", "_l.*").withColumn("x", F.col("fs") * F.col("k"))


@query("c08_payoff_extremes", PAYOFF_SQL.format(last=999) + """,
pay AS (SELECT p_partkey, structure, point, min(s) AS s, sum(sign * (CASE WHEN i < 0 THEN -premium ELSE i * delta - premium END) * scale + stock * (s - fs)) AS payoff FROM i GROUP BY 1, 2, 3)
SELECT p_partkey, structure, """ + SUMMARY_SQL.format(v="payoff", s="s", n=8) + " FROM pay GROUP BY 1, 2")
def _(spark, sf):
    keys = ["p_partkey", "structure"]
    return _summary(op.payoff_summary(payoff_legs(spark, sf), keys, F.col("fs") * 0.8, F.col("fs") * 1.2), keys, 8)


@query("c09_iv_hv_report", with_(panel_sql() + _vol_sql({"a": 30, "b": 90}, 36.0) + f""",
hv AS (SELECT symbol, ts, round(parkinson_b, 9) AS hv FROM vol WHERE parkinson_b IS NOT NULL), iv AS (SELECT symbol, ts, round(parkinson_a, 9) AS iv FROM vol WHERE parkinson_a IS NOT NULL),
r AS (SELECT b.symbol, b.ts, b.close, hv, iv, iv / hv AS iv_hv FROM bars b ASOF LEFT JOIN hv ON b.symbol = hv.symbol AND b.ts >= hv.ts
  ASOF LEFT JOIN iv ON b.symbol = iv.symbol AND b.ts >= iv.ts WHERE hv > 0 AND iv IS NOT NULL),
g AS (SELECT symbol, unnest([{_GRID}]) AS q, unnest(quantile_cont(iv, [{_GRID}])) AS vi, unnest(quantile_cont(iv_hv, [{_GRID}])) AS vr FROM r GROUP BY symbol)
SELECT r.symbol, r.ts, round(any_value(close), 6) AS close, round(any_value(iv_hv), 5) AS iv_hv, CAST(arg_min(q, ROW(abs(vi - iv), q)) AS DOUBLE) AS iv_rank,
  CAST(arg_min(q, ROW(abs(vr - iv_hv), q)) AS DOUBLE) AS iv_hv_rank FROM r JOIN g ON r.symbol = g.symbol GROUP BY 1, 2""", ""))
def _(spark, sf):
    v = vol.rolling_volatility(feeds.panel(spark, sf), {"a": 30, "b": 90}, 36.0, ["parkinson"])
    hv = v.where("parkinson_b is not null").select("symbol", "ts", F.round("parkinson_b", 9).alias("hv"))
    iv = v.where("parkinson_a is not null").select("symbol", "ts", F.round("parkinson_a", 9).alias("iv"))
    rows = op.iv_hv_rows(feeds.bars(spark, sf).select("symbol", "ts", "close"), hv, iv)
    d = op.iv_hv_report(feeds.stored(spark, sf, "iv-hv", lambda: rows))
    return d.select("symbol", "ts", F.round("close", 6).alias("close"), F.round("iv_hv", 5).alias("iv_hv"), "iv_rank", "iv_hv_rank")


@query("e14_business_year_fraction", """
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE isodow(l_shipdate) <= 5), c AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM cal)
SELECT o_orderkey, round(coalesce(((SELECT count(*) FROM cal WHERE day < CAST(o_orderdate AS DATE) + 90) - (SELECT count(*) FROM cal WHERE day < CAST(o_orderdate AS DATE))), 0) / 252e0, 9) AS year_fraction FROM orders""")
def _(spark, sf):
    li, o = feeds.table(spark, sf, "lineitem"), feeds.table(spark, sf, "orders")
    cal = li.where(F.dayofweek("l_shipdate").between(2, 6)).select(F.to_date("l_shipdate").alias("day")).distinct()
    spans = o.select("o_orderkey", F.to_date("o_orderdate").alias("start_day"), F.date_add(F.to_date("o_orderdate"), 90).alias("end_day"))
    return op.business_year_fraction(spans, cal).select("o_orderkey", F.round("year_fraction", 9).alias("year_fraction"))
