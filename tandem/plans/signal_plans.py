"""Spread features, trades and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import aggregates as agg, clean, regression as rg, signals as sg, spreads as sp
from tandem.plans import feeds
from tandem.plans.feeds import bars_sql, panel_sql, with_
from tandem.plans.registry import query

DAYS = 14
SESSION_HOURS = 24.0  # the event tables trade round the clock
# The test data's spreads are narrow (0.1 % of the price), so the band floor is lower here than the default.
LIMITS = dict(min_std_rate=0.0002, std_percent=0.1)

MODELS_SQL = panel_sql() + f""",
md AS (SELECT DISTINCT CAST(ts AS DATE) AS model_date FROM panel WHERE ts >= (SELECT min(ts) FROM panel) + INTERVAL '{DAYS} days'),
ends AS (SELECT model_date, max(ts) AS end_ts, max(rn) AS end_rn FROM panel JOIN md ON CAST(ts AS DATE) = model_date GROUP BY 1),
win AS (SELECT model_date, end_ts, end_rn, (SELECT min(rn) FROM panel WHERE ts >= end_ts - INTERVAL '{DAYS} days') AS start_rn FROM ends),
pr AS (SELECT a.symbol AS n1, b.symbol AS n2, a.ts, a.rn, a.close AS x, b.close AS y, (a.close + a.high + a.low) / 3 AS p1,
  (b.close + b.high + b.low) / 3 AS p2 FROM panel a JOIN panel b ON a.ts = b.ts AND a.symbol < b.symbol),
wr AS (SELECT p.*, w.* FROM pr p JOIN win w ON p.rn BETWEEN w.start_rn AND w.end_rn),
fit AS (SELECT n1, n2, model_date, end_ts, end_rn, start_rn, min(ts) AS model_start_ts, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM wr GROUP BY ALL),
res AS (SELECT w.n1, w.n2, w.model_date, w.rn - w.start_rn AS k0, x * s + i - y AS e FROM wr w JOIN fit f USING (n1, n2, model_date)),
rl AS (SELECT *, lag(e) OVER w AS e1, lead(e) OVER w AS e9 FROM res WINDOW w AS (PARTITION BY n1, n2, model_date ORDER BY k0)),
rs AS (SELECT n1, n2, model_date, stddev_samp(e) AS st, round_even(-ln(2) / regr_slope(CASE WHEN k0 = 0 THEN e9 - e ELSE e - e1 END,
  CASE WHEN k0 = 0 THEN e ELSE e1 END), 2) AS halflife FROM rl GROUP BY ALL),
models AS (SELECT * REPLACE (round(s, 5) AS s, round(i, 5) AS i, round(st, 5) AS st), CAST(4 * (floor(halflife) + 1) AS BIGINT) AS lookback
  FROM fit JOIN rs USING (n1, n2, model_date) WHERE s > 0.05 AND halflife > 0)"""

BOUND_SQL = MODELS_SQL + """,
ranges AS (SELECT model_date, (SELECT min(ts) FROM panel WHERE ts >= model_date + INTERVAL '86399 seconds') AS start_ts FROM md)"""
RANGE_SQL = BOUND_SQL + """,
sprd AS (SELECT p.n1, p.n2, m.model_date, p.ts, p.rn, p.p1, p.p2, m.s * p.p1 - p.p2 AS diff, m.lookback, m.end_rn, m.end_ts, m.model_start_ts, r.start_ts,
  CASE WHEN p.ts >= r.start_ts THEN 2 WHEN p.rn > m.end_rn - m.lookback THEN 1 ELSE 0 END AS role
  FROM pr p JOIN models m ON p.n1 = m.n1 AND p.n2 = m.n2 JOIN ranges r ON r.model_date = m.model_date
  WHERE p.rn >= m.start_rn AND p.ts < r.start_ts + INTERVAL '36 hours' AND r.start_ts IS NOT NULL)"""


def models(spark, sf):
    def build():
        p = feeds.panel(spark, sf)
        dates = clean.trading_dates(p, DAYS).select(F.date_sub("model_date", 1).alias("model_date"))
        m = rg.dated_models(p, dates, DAYS)
        # Models are kept with 5 decimals, as the model files hold them.
        m = m.where("s > 0.05 and halflife > 0").withColumns({c: F.round(c, 5) for c in ("s", "i", "st")})
        m = m.select("n1", "n2", "model_date", F.col("s").alias("slope"), "s", "i", "m", "st", "halflife", "start_rn", "end_rn",
                     "end_ts", F.col("start").alias("model_start_ts"), "he")
        return m.withColumn("lookback", sp.lookback())
    return feeds.stored(spark, sf, "models", build)


def ranged_models(spark, sf):
    """Models with their test ranges."""
    m = models(spark, sf)
    ranges = clean.bt_range(feeds.panel(spark, sf), m, session_hours=SESSION_HOURS).withColumnRenamed("end_ts", "end_test_ts")
    return m.join(ranges, "model_date")


def spread_rows(spark, sf):
    return sp.warm_start(sp.spread(ranged_models(spark, sf), feeds.panel(spark, sf))).withColumn("halflife_secs", F.floor(F.col("halflife") * 600))


def features(spark, sf):
    return feeds.stored(spark, sf, "spread-features", lambda: sp.spread_features(spread_rows(spark, sf)))


def key():
    return ["n1", "n2", F.col("model_date").cast("string").alias("model_date"), "ts"]


KEY_SQL = "n1, n2, CAST(CAST(model_date AS DATE) AS VARCHAR) AS model_date, ts"


def _r(*names, n=6):
    return [F.round(c, n).alias(c) for c in names]


def _rs(*names, n=6):
    return ", ".join(f"round({c}, {n}) AS {c}" for c in names)


@query("k_dated_models", with_(MODELS_SQL, """
SELECT n1, n2, CAST(model_date AS VARCHAR) AS model_date, round(s, 5) AS s, round(i, 2) AS i, round(st, 6) AS st, halflife, lookback FROM models"""))
def _(spark, sf):
    return models(spark, sf).select("n1", "n2", F.col("model_date").cast("string").alias("model_date"), F.round("s", 5).alias("s"),
                                    F.round("i", 2).alias("i"), F.round("st", 6).alias("st"), "halflife", "lookback")


@query("w16_spread", with_(RANGE_SQL, """
SELECT n1, n2, CAST(model_date AS VARCHAR) AS model_date, ts, p1, p2, diff FROM sprd"""))
def _(spark, sf):
    return sp.spread(ranged_models(spark, sf), feeds.panel(spark, sf)).select(*key(), "p1", "p2", "diff")


@query("k05_warm_start", with_(RANGE_SQL, f"SELECT {KEY_SQL}, role, diff FROM sprd"))
def _(spark, sf):
    return spread_rows(spark, sf).select(*key(), "role", "diff")


EMA_SQL = "WITH RECURSIVE " + RANGE_SQL.strip() + """,
seq AS (SELECT *, row_number() OVER (PARTITION BY n1, n2, model_date ORDER BY rn) AS k, greatest(lookback // 2, 5) AS half,
  greatest(lookback // 2 // 2, 5) AS quarter FROM sprd WHERE role > 0),
e AS (SELECT n1, n2, model_date, ts, k, diff, role, lookback, half, quarter, diff AS ema, diff AS ema_half, diff AS ema_quarter, diff AS ema_5bars,
    0e0 AS em_var, 0e0 AS em_var_half, 0e0 AS em_var_quarter, 0e0 AS em_var_5bars FROM seq WHERE k = 1
  UNION ALL SELECT s.n1, s.n2, s.model_date, s.ts, s.k, s.diff, s.role, s.lookback, s.half, s.quarter, """ + ", ".join(
    f"e.ema{n} + 2e0 / (1 + {w}) * (s.diff - e.ema{n})" for n, w in (("", "s.lookback"), ("_half", "s.half"), ("_quarter", "s.quarter"), ("_5bars", "5"))
) + ", " + ", ".join(
    f"CASE WHEN s.k = 2 THEN pow(s.diff - e.diff, 2) ELSE 2e0 / (1 + {w}) * pow(s.diff - e.ema{n}, 2) + (1 - 2e0 / (1 + {w})) * e.em_var{n} END"
    for n, w in (("", "s.lookback"), ("_half", "s.half"), ("_quarter", "s.quarter"), ("_5bars", "5"))) + """
  FROM e JOIN seq s ON s.n1 = e.n1 AND s.n2 = e.n2 AND s.model_date = e.model_date AND s.k = e.k + 1)"""
EMAS = [f"{p}{s}" for p in ("ema", "em_var") for s in ("", "_half", "_quarter", "_5bars")]


@query("w17_spread_ema", EMA_SQL + f" SELECT {KEY_SQL}, {_rs(*EMAS, n=5)} FROM e WHERE role = 2")
def _(spark, sf):
    return features(spark, sf).select(*key(), *_r(*EMAS, n=5))


ROLL_SQL = RANGE_SQL + """,
seq AS (SELECT *, row_number() OVER (PARTITION BY n1, n2, model_date ORDER BY rn) AS k FROM sprd WHERE role > 0),
rolled AS (SELECT *, CASE WHEN role = 2 THEN avg(diff) OVER w END AS mean, CASE WHEN role = 2 THEN stddev_samp(diff) OVER w END AS std,
  avg(diff) OVER (PARTITION BY n1, n2, model_date ORDER BY k ROWS BETWEEN greatest(least(k, lookback + 1) // 2 - 1, 0) PRECEDING AND CURRENT ROW) AS mean_half,
  abs(diff - lag(diff) OVER (PARTITION BY n1, n2, model_date ORDER BY k)) AS dd
  FROM seq WINDOW w AS (PARTITION BY n1, n2, model_date ORDER BY k ROWS BETWEEN lookback PRECEDING AND CURRENT ROW)),
feat AS (SELECT *, avg(CASE WHEN std > 0 THEN std END) OVER (v ROWS 4 PRECEDING) AS sm_std_5, avg(CASE WHEN std > 0 THEN std END) OVER (v ROWS 9 PRECEDING) AS sm_std_10,
  avg(CASE WHEN std > 0 THEN std END) OVER (v ROWS 19 PRECEDING) AS sm_std_20, max(std) OVER (v ROWS UNBOUNDED PRECEDING) AS stdH,
  min(std) OVER (v ROWS UNBOUNDED PRECEDING) AS stdL, max(CASE WHEN role = 2 THEN diff END) OVER (v ROWS UNBOUNDED PRECEDING) AS diffH,
  min(CASE WHEN role = 2 THEN diff END) OVER (v ROWS UNBOUNDED PRECEDING) AS diffL, avg(dd) OVER (v ROWS 4 PRECEDING) AS avg_diffdiff
  FROM rolled WINDOW v AS (PARTITION BY n1, n2, model_date ORDER BY k))"""


@query("w18_spread_roll", with_(ROLL_SQL, f"SELECT {KEY_SQL}, {_rs('mean', 'mean_half', 'std', n=5)} FROM feat WHERE role = 2"))
def _(spark, sf):
    return features(spark, sf).select(*key(), *_r("mean", "mean_half", "std", n=5))


@query("w19_z_score", EMA_SQL + f" SELECT {KEY_SQL}, round((ema_5bars - ema) / sqrt(em_var), 4) AS z FROM e WHERE role = 2")
def _(spark, sf):
    return features(spark, sf).select(*key(), F.round("z", 4).alias("z"))


@query("w19_z_simple", with_(BOUND_SQL, """
SELECT p.n1, p.n2, CAST(m.model_date AS VARCHAR) AS model_date, p.ts, round((x * s + i - y) / st, 4) + 0 AS z
FROM pr p JOIN models m ON p.n1 = m.n1 AND p.n2 = m.n2 JOIN ranges r ON r.model_date = m.model_date
WHERE p.rn > m.end_rn AND p.ts < r.start_ts + INTERVAL '36 hours'"""))
def _(spark, sf):
    return simple_z(spark, sf).where("rn > end_rn").select(*key(), F.round("z", 4).alias("z"))


def pair_closes(spark, sf):
    p = feeds.panel(spark, sf)
    x = p.select(F.col("symbol").alias("n1"), "ts", "rn", F.col("close").alias("x"))
    y = p.select(F.col("symbol").alias("n2"), "ts", F.col("close").alias("y"))
    return x.join(y, "ts").where("n1 < n2")


def simple_z(spark, sf):
    """z of every model from its start to the end of its test range."""
    rows = sp.on_model_days(pair_closes(spark, sf), ranged_models(spark, sf)).where("rn >= start_rn and ts < end_test_ts")
    return rows.withColumn("z", sp.z_simple())


@query("w20_sm_std", with_(ROLL_SQL, f"SELECT {KEY_SQL}, {_rs('sm_std_5', 'sm_std_10', 'sm_std_20', n=5)} FROM feat WHERE role = 2"))
def _(spark, sf):
    return features(spark, sf).select(*key(), *_r("sm_std_5", "sm_std_10", "sm_std_20", n=5))


@query("w21_run_high_low", with_(ROLL_SQL, f"SELECT {KEY_SQL}, {_rs('stdH', 'stdL', 'diffH', 'diffL', n=5)} FROM feat WHERE role = 2"))
def _(spark, sf):
    return features(spark, sf).select(*key(), *_r("stdH", "stdL", "diffH", "diffL", n=5))


@query("w21_run_high_low_of_bars", with_(bars_sql(), """
SELECT symbol, ts, max(close) OVER w AS "closeH", min(close) OVER w AS "closeL" FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING)"""))
def _(spark, sf):
    return sp.run_high_low(feeds.bars(spark, sf), "close", slice_rows=500).select("symbol", "ts", "closeH", "closeL")


@query("w22_avg_diffdiff", with_(ROLL_SQL, f"SELECT {KEY_SQL}, {_rs('avg_diffdiff', n=5)} FROM feat WHERE role = 2"))
def _(spark, sf):
    return features(spark, sf).select(*key(), *_r("avg_diffdiff", n=5))


@query("w23_long_window_stats", with_(panel_sql(), """
, pr AS (SELECT a.symbol AS n1, b.symbol AS n2, a.ts, a.rn, ln(a.close) - ln(b.close) AS diff FROM panel a JOIN panel b ON a.ts = b.ts AND a.symbol < b.symbol)
SELECT n1, n2, ts, round(avg(diff) OVER w, 10) AS mean0, round(stddev_samp(diff) OVER w, 9) AS std0 FROM pr
WINDOW w AS (PARTITION BY n1, n2 ORDER BY ts RANGE BETWEEN INTERVAL '3 days' PRECEDING AND CURRENT ROW)"""))
def _(spark, sf):
    p = feeds.panel(spark, sf)
    x = p.select(F.col("symbol").alias("n1"), "ts", "rn", F.col("close").alias("x"))
    y = p.select(F.col("symbol").alias("n2"), "ts", F.col("close").alias("y"))
    rows = x.join(y, "ts").where("n1 < n2").withColumn("diff", F.log("x") - F.log("y"))
    d = sp.long_window_stats(rows, 3 * 86_400)
    return d.select("n1", "n2", "ts", F.round("mean0", 10).alias("mean0"), F.round("std0", 9).alias("std0"))


@query("w24_std_percent", with_(ROLL_SQL, f"""
SELECT {KEY_SQL}, round((std - stdL) / nullif(stdH - stdL, 0), 4) + 0 AS std_percent FROM feat WHERE role = 2"""))
def _(spark, sf):
    return features(spark, sf).select(*key(), F.round(sp.std_percent(), 4).alias("std_percent"))


CROSS_SQL = BOUND_SQL + """,
z AS (SELECT p.n1, p.n2, m.model_date, p.ts, p.rn, round((x * s + i - y) / st, 4) AS z FROM pr p JOIN models m ON p.n1 = m.n1 AND p.n2 = m.n2
  JOIN ranges r ON r.model_date = m.model_date WHERE p.rn >= m.start_rn AND p.ts < r.start_ts + INTERVAL '36 hours'),
zl AS (SELECT *, lag(z) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3 FROM z WINDOW w AS (PARTITION BY n1, n2, model_date ORDER BY rn))"""


@query("w25_cross_in", with_(CROSS_SQL, f"""
SELECT {KEY_SQL}, CASE WHEN z BETWEEN 1.7 AND 2 AND z1 > 2 AND z1 <= z2 AND z2 <= z3 THEN 1
  WHEN z BETWEEN -2 AND -1.7 AND z1 < -2 AND z1 >= z2 AND z2 >= z3 THEN -1 ELSE 0 END AS "cross" FROM zl"""))
def _(spark, sf):
    d = simple_z(spark, sf).withColumn("z", F.round("z", 4))
    return sp.cross_in(d).select(*key(), "cross")


def _test_day(spark, sf):
    m = models(spark, sf)
    p = feeds.panel(spark, sf)
    # (model date, time) pairs of the test days come from one symbol's times: all symbols share them.
    times = p.groupBy("ts").agg(F.first("rn").alias("rn"))
    days = clean.test_window(times, m, next_open=True).select("model_date", "ts")
    wanted = days.join(m, "model_date")  # a model meets the pair rows of its test times only
    return pair_closes(spark, sf).join(wanted, ["n1", "n2", "ts"]).withColumn("z", sp.z_simple())


def z_trades(spark, sf):
    return sg.trades_z_trailing(_test_day(spark, sf))


# The scans as recursion over each model's rows: one state row per bar.
Z_SCAN_SQL = "WITH RECURSIVE " + MODELS_SQL.strip() + """,
tdays AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM panel),
td AS (SELECT model_date, nth_value(day, 2) OVER (PARTITION BY model_date ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d2,
  nth_value(day, 3) OVER (PARTITION BY model_date ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d3
  FROM (SELECT DISTINCT model_date FROM models) m JOIN tdays ON day >= model_date),
td1 AS (SELECT DISTINCT model_date, d2, (SELECT min(ts) FROM panel WHERE CAST(ts AS DATE) = d3) AS next_open FROM td WHERE d2 IS NOT NULL),
zr AS (SELECT p.n1, p.n2, m.model_date, p.ts, p.x, p.y, m.s, m.st, (p.x * m.s + m.i - p.y) / m.st AS z, CAST(p.ts AS DATE) <> t.d2 AS new_day,
  row_number() OVER (PARTITION BY p.n1, p.n2, m.model_date ORDER BY p.ts) AS k
  FROM pr p JOIN models m ON p.n1 = m.n1 AND p.n2 = m.n2 JOIN td1 t ON t.model_date = m.model_date WHERE CAST(p.ts AS DATE) = t.d2 OR p.ts = t.next_open),
scan AS (SELECT DISTINCT n1, n2, model_date, CAST(0 AS BIGINT) AS k, 0e0 AS z, false AS held, 0e0 AS z0, 0e0 AS x0, 0e0 AS y0, false AS closed, 0e0 AS tz0, 0e0 AS tx0, 0e0 AS ty0 FROM zr
  UNION ALL SELECT n1, n2, model_date, k, z, CASE WHEN held THEN NOT shut ELSE enter END, CASE WHEN held THEN z0 ELSE z END, CASE WHEN held THEN x0 ELSE x END,
    CASE WHEN held THEN y0 ELSE y END, held AND shut, z0, x0, y0 FROM (
    SELECT r.n1, r.n2, r.model_date, r.k, r.z, r.x, r.y, c.held, c.z0, c.x0, c.y0,
      r.new_day OR (r.z - c.z0) * sign(c.z0) > 1 OR (NOT (r.z - c.z) * sign(c.z0) < 0 AND (r.z - c.z0) * sign(c.z0) < -1) AS shut,
      NOT r.new_day AND NOT ((c.z < 0 AND r.z < c.z) OR (c.z > 0 AND r.z > c.z)) AND abs(r.z) > 2 AS enter
    FROM scan c JOIN zr r ON r.n1 = c.n1 AND r.n2 = c.n2 AND r.model_date = c.model_date AND r.k = c.k + 1)),
ztrades AS (SELECT r.n1, r.n2, r.model_date, CASE WHEN c.tz0 < 0 THEN 1 ELSE -1 END AS side, r.x, r.y, r.s, r.st, c.tz0, c.tx0, c.ty0, r.z, r.new_day
  FROM scan c JOIN zr r ON r.n1 = c.n1 AND r.n2 = c.n2 AND r.model_date = c.model_date AND r.k = c.k WHERE c.closed),
ztr AS (SELECT n1, n2, model_date, ((x - tx0) * side * 100 * s - (y - ty0) * side * 100) / greatest(abs(100 * s * tx0), abs(100 * ty0)) * 100 AS rt, z - tz0 AS dz, tz0 AS z0, z,
  100 * st / greatest(tx0, ty0) AS std_xy_percent, CAST(new_day OR (z - tz0) * sign(tz0) > 1 AS INTEGER) AS stop FROM ztrades)"""


@query("k01_trades_z_trailing", Z_SCAN_SQL + """
SELECT n1, n2, CAST(CAST(model_date AS DATE) AS VARCHAR) AS model_date, round(rt, 6) AS rt, round(dz, 6) AS dz, round(z0, 6) AS z0, round(z, 6) AS z,
  round(std_xy_percent, 8) AS std_xy_percent, stop FROM ztr""")
def _(spark, sf):
    d = z_trades(spark, sf)
    return d.select("n1", "n2", F.col("model_date").cast("string").alias("model_date"), *_r("rt", "dz", "z0", "z"),
                    F.round("std_xy_percent", 8).alias("std_xy_percent"), "stop")


def _v0_rows(spark, sf):
    d = simple_z(spark, sf).where("ts >= start_ts")
    return d.select("n1", "n2", "model_date", "ts", F.col("x").alias("p1"), F.col("y").alias("p2"), "z", "slope",
                    F.floor(F.col("halflife") * 600).alias("halflife_secs"))


SIZE_SQL = """CASE WHEN round(round(10000 / y) * slope) * x > 10000 THEN round(10000 / x) ELSE round(round(10000 / y) * slope) END AS ux,
  CASE WHEN round(round(10000 / y) * slope) * x > 10000 THEN round(round(10000 / x) / slope) ELSE round(10000 / y) END AS uy"""
LEGS_OUT = """n1, n2, CAST(CAST(model_date AS DATE) AS VARCHAR) AS model_date, round(profit, 5) AS profit, x0, x1, pos_x, y0, y1, pos_y, tm_o, tm_c, tick_o, tick_c, reason"""


def legs_out(d):
    return d.withColumns({"model_date": F.col("model_date").cast("string"), "profit": F.round("profit", 5)})


V0_SQL = "WITH RECURSIVE " + MODELS_SQL.strip() + f""",
ranges AS (SELECT model_date, (SELECT min(ts) FROM panel WHERE ts >= model_date + INTERVAL '86399 seconds') AS start_ts FROM md),
vr AS (SELECT p.n1, p.n2, m.model_date, p.ts, p.x, p.y, m.s AS slope, (p.x * m.s + m.i - p.y) / m.st AS z, floor(m.halflife * 600) AS hl,
  date_diff('second', min(p.ts) OVER (PARTITION BY p.n1, p.n2, m.model_date), p.ts) AS secs, row_number() OVER (PARTITION BY p.n1, p.n2, m.model_date ORDER BY p.ts) AS k
  FROM pr p JOIN models m ON p.n1 = m.n1 AND p.n2 = m.n2 JOIN ranges r ON r.model_date = m.model_date WHERE p.ts >= r.start_ts AND p.ts < r.start_ts + INTERVAL '36 hours'),
sized AS (SELECT *, {SIZE_SQL} FROM vr),
scan AS (SELECT DISTINCT n1, n2, model_date, CAST(0 AS BIGINT) AS k, 0e0 AS z, false AS held, false AS done, 0e0 AS z0, CAST(0 AS BIGINT) AS k0, 0 AS secs0, NULL::VARCHAR AS reason FROM vr
  UNION ALL SELECT n1, n2, model_date, k, z, CASE WHEN held THEN why IS NULL ELSE enter END, done OR (held AND why IS NOT NULL), CASE WHEN held THEN z0 ELSE z END,
    CASE WHEN held THEN k0 ELSE k END, CASE WHEN held THEN secs0 ELSE secs END, CASE WHEN held THEN why END FROM (
    SELECT r.n1, r.n2, r.model_date, r.k, r.z, r.secs, c.held, c.done, c.z0, c.k0, c.secs0,
      CASE WHEN r.secs > 10800 THEN 'force' WHEN r.secs - c.secs0 > r.hl THEN 'timeout' WHEN (r.z - c.z) * sign(c.z0) < 0 THEN NULL
        WHEN (r.z - c.z0) * sign(c.z0) < 0 THEN CASE WHEN abs(c.z - c.z0) > 1.3e0 THEN 'profit' END WHEN abs(r.z - c.z0) > 1 THEN 'stop' END AS why,
      r.secs <= 10800 AND NOT ((c.z < 0 AND r.z < c.z) OR (c.z > 0 AND r.z > c.z)) AND abs(r.z) > 2 AS enter
    FROM scan c JOIN vr r ON r.n1 = c.n1 AND r.n2 = c.n2 AND r.model_date = c.model_date AND r.k = c.k + 1 WHERE NOT c.done)),
tr AS (SELECT a.n1, a.n2, a.model_date, o.x AS x0, b.x AS x1, o.y AS y0, b.y AS y1, CAST(CASE WHEN o.z > 0 THEN -o.ux ELSE o.ux END AS BIGINT) AS pos_x,
  CAST(CASE WHEN o.z > 0 THEN o.uy ELSE -o.uy END AS BIGINT) AS pos_y, o.ts AS tm_o, b.ts AS tm_c, a.k0 AS tick_o, a.k AS tick_c, a.reason FROM scan a
  JOIN sized o ON o.n1 = a.n1 AND o.n2 = a.n2 AND o.model_date = a.model_date AND o.k = a.k0 JOIN sized b ON b.n1 = a.n1 AND b.n2 = a.n2 AND b.model_date = a.model_date AND b.k = a.k
  WHERE a.reason IS NOT NULL),
legs AS (SELECT *, (x1 - x0) * pos_x + (y1 - y0) * pos_y - 0.01e0 * (abs(pos_x) + abs(pos_y)) AS profit FROM tr)"""


@query("k02_trades_v0", V0_SQL + f" SELECT {LEGS_OUT} FROM legs")
def _(spark, sf):
    return legs_out(sg.trades_v0(_v0_rows(spark, sf)))


def v1_trades(spark, sf):
    return feeds.stored(spark, sf, "trades-v1", lambda: sg.trades_v1(spread_rows(spark, sf), {**LIMITS, "session_secs": 7 * 86_400}))


V1_SQL = EMA_SQL + ROLL_SQL[len(RANGE_SQL):].replace("seq AS", "seq2 AS").replace("FROM seq ", "FROM seq2 ") + f""",
zz AS (SELECT n1, n2, model_date, ts, k, role, em_var, CASE WHEN role = 2 THEN (ema_5bars - ema) / sqrt(em_var) ELSE 0e0 END AS z FROM e),
zl AS (SELECT *, lag(z) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3 FROM zz WINDOW w AS (PARTITION BY n1, n2, model_date ORDER BY k)),
f0 AS (SELECT f.n1, f.n2, f.model_date, f.ts, f.diff, f.mean, f.std, f.stdH, f.stdL, f.p1 AS x, f.p2 AS y, z.z, z.z1, z.z2, z.z3, z.em_var, m.s AS slope, floor(m.halflife * 600) AS hl
  FROM feat f JOIN zl z ON z.n1 = f.n1 AND z.n2 = f.n2 AND z.model_date = f.model_date AND z.ts = f.ts JOIN models m ON m.n1 = f.n1 AND m.n2 = f.n2 AND m.model_date = f.model_date WHERE f.role = 2),
fr AS (SELECT *, {SIZE_SQL}, row_number() OVER w AS t, date_diff('second', first_value(ts) OVER w, ts) AS secs, lag(diff) OVER w AS pdiff, lag(mean) OVER w AS pmean, lag(std) OVER w AS pstd
  FROM f0 WINDOW w AS (PARTITION BY n1, n2, model_date ORDER BY ts)),
gate AS (SELECT *, CASE WHEN sqrt(em_var) / (x * slope + y) < {LIMITS['min_std_rate']} OR hl > 604800 - secs OR secs < 900 OR (stdH > stdL AND (std - stdL) / (stdH - stdL) < {LIMITS['std_percent']}) THEN 0
  WHEN z BETWEEN 1.7 AND 2 AND z1 > 2 AND z1 <= z2 AND z2 <= z3 THEN 1 WHEN z BETWEEN -2 AND -1.7 AND z1 < -2 AND z1 >= z2 AND z2 >= z3 THEN -1 ELSE 0 END AS dir FROM fr),
scan AS (SELECT DISTINCT n1, n2, model_date, CAST(0 AS BIGINT) AS t, 0 AS side, 0e0 AS cap, CAST(0 AS BIGINT) AS t0, 0 AS secs0, 0e0 AS x0, 0e0 AS y0, 0e0 AS px, 0e0 AS py,
    false AS c3, false AS c2, false AS c1, false AS c0, NULL::VARCHAR AS reason FROM gate
  UNION ALL SELECT n1, n2, model_date, t, CASE WHEN side = 0 THEN dir WHEN why IS NULL THEN side ELSE 0 END, CASE WHEN side = 0 THEN mean + 0.25e0 * z * std ELSE cap END,
    CASE WHEN side = 0 THEN t ELSE t0 END, CASE WHEN side = 0 THEN secs ELSE secs0 END, CASE WHEN side = 0 THEN x ELSE x0 END, CASE WHEN side = 0 THEN y ELSE y0 END,
    CASE WHEN side = 0 THEN -dir * ux ELSE px END, CASE WHEN side = 0 THEN dir * uy ELSE py END, side <> 0 AND (c3 OR (runs AND l3 < 0)), side <> 0 AND (c2 OR (runs AND l2 < 0)),
    side <> 0 AND (c1 OR (runs AND l1 < 0)), side <> 0 AND (c0 OR (runs AND l0 < 0)), CASE WHEN side <> 0 THEN why END
  FROM (SELECT *, CASE WHEN side = 0 OR runs THEN NULL WHEN (x - x0) * px + (y - y0) * py - 0.01e0 * (abs(px) + abs(py)) < -300 THEN 'loss' WHEN (diff - cap) * side <= 0 THEN 'cap'
      WHEN 2 * hl < secs - secs0 THEN 'timeout' WHEN (c3 AND l3 > 0) OR (c2 AND l2 > 0) OR (c1 AND l1 > 0) OR (c0 AND l0 > 0) THEN 'line' END AS why
    FROM (SELECT r.*, c.side, c.cap, c.t0, c.secs0, c.x0, c.y0, c.px, c.py, c.c3, c.c2, c.c1, c.c0, (r.diff - r.pdiff) * c.side < 0 AS runs,
      (r.pdiff - (r.pmean - 3 * c.side * r.pstd)) * c.side AS l3, (r.pdiff - (r.pmean - 2 * c.side * r.pstd)) * c.side AS l2,
      (r.pdiff - (r.pmean - c.side * r.pstd)) * c.side AS l1, (r.pdiff - r.pmean) * c.side AS l0
      FROM scan c JOIN gate r ON r.n1 = c.n1 AND r.n2 = c.n2 AND r.model_date = c.model_date AND r.t = c.t + 1))),
tr AS (SELECT a.n1, a.n2, a.model_date, a.x0, b.x AS x1, CAST(a.px AS BIGINT) AS pos_x, a.y0, b.y AS y1, CAST(a.py AS BIGINT) AS pos_y, o.ts AS tm_o, b.ts AS tm_c, a.t0 AS tick_o, a.t AS tick_c, a.reason
  FROM scan a JOIN gate o ON o.n1 = a.n1 AND o.n2 = a.n2 AND o.model_date = a.model_date AND o.t = a.t0 JOIN gate b ON b.n1 = a.n1 AND b.n2 = a.n2 AND b.model_date = a.model_date AND b.t = a.t
  WHERE a.reason IS NOT NULL),
legs AS (SELECT *, (x1 - x0) * pos_x + (y1 - y0) * pos_y - 0.01e0 * (abs(pos_x) + abs(pos_y)) AS profit FROM tr)"""


@query("k03_trades_v1", V1_SQL + f" SELECT {LEGS_OUT} FROM legs")
def _(spark, sf):
    return legs_out(v1_trades(spark, sf))


@query("k04_trades_sma_cross", with_(bars_sql(), """
, m AS (SELECT *, CASE WHEN rn >= 4 THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 4 PRECEDING) END AS f,
  CASE WHEN rn >= 14 THEN avg(close) OVER (PARTITION BY symbol ORDER BY rn ROWS 14 PRECEDING) END AS s FROM bars),
g AS (SELECT *, CASE WHEN close > f AND f > s THEN 1 WHEN close < f AND f < s THEN -1 END AS sig FROM m),
st AS (SELECT symbol, ts, close, rn, sig FROM g WHERE sig IS NOT NULL),
fl AS (SELECT * FROM (SELECT *, lag(sig) OVER (PARTITION BY symbol ORDER BY rn) AS was FROM st) WHERE sig IS DISTINCT FROM was),
pairs AS (SELECT *, lag(ts) OVER w AS tm_o, lag(close) OVER w AS price_o, lag(sig) OVER w AS o FROM fl WINDOW w AS (PARTITION BY symbol ORDER BY rn))
SELECT symbol, tm_o, ts AS tm_c, price_o, close AS price_c, close - price_o AS profit FROM pairs WHERE sig = -1 AND o = 1"""))
def _(spark, sf):
    return sg.trades_sma_cross(feeds.bars(spark, sf), slice_rows=500)


# Round trips priced from line items: entry at the base price, exit after discount and tax.
LEG_SQL = """
legs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS n1, p_type AS n2, l_returnflag AS scenario, p_retailprice / 10 AS x0,
  p_retailprice / 10 * (1 - l_discount) AS x1, 50e0 + p_size AS y0, (50e0 + p_size) * (1 + l_tax) AS y1, 0.2e0 + l_quantity / 20 AS slope,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS direction, l_shipdate AS tm_o FROM lineitem JOIN part ON l_partkey = p_partkey),
s0 AS (SELECT *, CAST(round(10000 / y0) AS BIGINT) AS by_y, CAST(round(10000 / x0) AS BIGINT) AS by_x FROM legs),
s1 AS (SELECT *, round(by_y * slope) * x0 > 10000 AS over FROM s0),
s2 AS (SELECT *, CASE WHEN over THEN by_x ELSE CAST(round(by_y * slope) AS BIGINT) END AS ux, CASE WHEN over THEN CAST(round(by_x / slope) AS BIGINT) ELSE by_y END AS uy FROM s1),
sized AS (SELECT *, CASE WHEN direction > 0 THEN -ux ELSE ux END AS pos_x, CASE WHEN direction > 0 THEN uy ELSE -uy END AS pos_y FROM s2),
pnl AS (SELECT *, (x1 - x0) * pos_x + (y1 - y0) * pos_y - 0.01e0 * (abs(pos_x) + abs(pos_y)) AS profit,
  ((x1 - x0) * pos_x + (y1 - y0) * pos_y) / greatest(abs(pos_x * x0), abs(pos_y * y0)) * 100 AS rt FROM sized)"""


def leg_trades(spark, sf):
    li, part = feeds.table(spark, sf, "lineitem"), feeds.table(spark, sf, "part")
    d = li.join(part, F.expr("l_partkey = p_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p_brand").alias("n1"), F.col("p_type").alias("n2"),
        F.col("l_returnflag").alias("scenario"), (F.col("p_retailprice") / 10).alias("x0"),
        (F.col("p_retailprice") / 10 * (1 - F.col("l_discount"))).alias("x1"), (50.0 + F.col("p_size")).alias("y0"),
        ((50.0 + F.col("p_size")) * (1 + F.col("l_tax"))).alias("y1"), (0.2 + F.col("l_quantity") / 20).alias("slope"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("direction"), F.col("l_shipdate").alias("tm_o"))
    px, py = sp.size_pair(F.col("x0"), F.col("y0"), F.col("slope"), F.col("direction"))
    d = d.withColumns({"pos_x": px, "pos_y": py})
    args = [F.col(c) for c in ("x0", "x1", "pos_x", "y0", "y1", "pos_y")]
    return d.withColumns({"profit": sp.pair_pnl(*args), "rt": sp.pair_return(*args)})


@query("e07_size_pair", with_(LEG_SQL, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pos_x, pos_y FROM sized"))
def _(spark, sf):
    return leg_trades(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pos_x", "pos_y")


@query("e08_pair_pnl", with_(LEG_SQL, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, profit, rt FROM pnl"))
def _(spark, sf):
    return leg_trades(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "profit", "rt")


@query("e09_profit_cap", with_(RANGE_SQL, """
, m AS (SELECT n1, n2, model_date, avg(diff) AS mean, stddev_samp(diff) AS std, arg_max(diff, rn) AS d FROM sprd GROUP BY ALL)
SELECT n1, n2, CAST(CAST(model_date AS DATE) AS VARCHAR) AS model_date, round(mean + 0.25 * ((d - mean) / std) * std, 5) AS cap FROM m"""))
def _(spark, sf):
    d = spread_rows(spark, sf).groupBy("n1", "n2", "model_date").agg(
        F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("std"), F.max_by("diff", "rn").alias("d"))
    cap = sp.profit_cap(F.col("mean"), (F.col("d") - F.col("mean")) / F.col("std"), F.col("std"))
    return d.select("n1", "n2", F.col("model_date").cast("string").alias("model_date"), F.round(cap, 5).alias("cap"))


@query("a05_backtest_summary", with_(LEG_SQL, """
SELECT scenario, count(rt) AS trades, round(avg(rt), 6) AS mean, round(stddev_samp(rt), 6) AS std, round(avg(rt) / stddev_samp(rt), 6) AS sharpe FROM pnl GROUP BY 1"""))
def _(spark, sf):
    d = agg.backtest_summary(leg_trades(spark, sf), ["scenario"])
    return d.select("scenario", "trades", *_r("mean", "std", "sharpe"))


@query("a05_backtest_of_z_trades", Z_SCAN_SQL + """
SELECT count(rt) AS trades, round(avg(rt), 6) AS mean, round(stddev_samp(rt), 6) AS std, round(avg(rt) / stddev_samp(rt), 5) AS sharpe FROM ztr""")
def _(spark, sf):
    return agg.backtest_summary(z_trades(spark, sf)).select("trades", *_r("mean", "std"), F.round("sharpe", 5).alias("sharpe"))


CUBE_SQL = """round(avg(rt), 5) + 0 AS mean, round(stddev_samp(rt), 5) AS std,
  CASE WHEN stddev_samp(rt) > 1e-6 THEN round(avg(rt) / stddev_samp(rt), 4) + 0 END AS sharpe"""


def _cube(d, *cols):
    zero = F.lit(0.0)
    return d.select("level", *cols, "trades", (F.round("mean", 5) + zero).alias("mean"), F.round("std", 5).alias("std"),
                    (F.round("sharpe", 4) + zero).alias("sharpe"))


@query("a05_cube_of_z_trades", Z_SCAN_SQL + f"""
, t AS (SELECT n1 || '_' || n2 AS pair, CAST(CAST(model_date AS DATE) AS VARCHAR) AS model_date, CAST(stop AS VARCHAR) AS stop, rt FROM ztr)
SELECT GROUPING(pair, model_date, stop) AS level, pair, model_date, stop, count(rt) AS trades, {CUBE_SQL} FROM t GROUP BY CUBE (pair, model_date, stop)""")
def _(spark, sf):
    d = z_trades(spark, sf).select(F.concat_ws("_", "n1", "n2").alias("pair"), F.col("model_date").cast("string").alias("model_date"),
                                   F.col("stop").cast("string").alias("stop"), "rt")
    dims = ["pair", "model_date", "stop"]
    return _cube(agg.backtest_cube(d, dims), *dims)


@query("a06_cube_of_scenarios", with_(LEG_SQL, f"""
, t AS (SELECT scenario, n1 AS brand, CAST(year(tm_o) AS VARCHAR) AS opened, CAST(direction AS VARCHAR) AS direction, rt, profit FROM pnl)
SELECT GROUPING(scenario, brand, opened, direction) AS level, scenario, brand, opened, direction, count(rt) AS trades, {CUBE_SQL}, round(sum(profit), 6) + 0 AS profit
FROM t GROUP BY CUBE (scenario, brand, opened, direction)"""))
def _(spark, sf):
    d = leg_trades(spark, sf).select("scenario", F.col("n1").alias("brand"), F.year("tm_o").cast("string").alias("opened"),
                                     F.col("direction").cast("string").alias("direction"), "rt", "profit")
    dims = ["scenario", "brand", "opened", "direction"]
    return _cube(agg.backtest_cube(d, dims, totals=["profit"]), *dims, (F.round("profit", 6) + F.lit(0.0)).alias("profit"))


@query("a06_contract_profit", with_(LEG_SQL, """
SELECT scenario, n1 || '_' || n2 AS pair, round(sum(profit), 6) + 0 AS profit, count(*) AS transactions FROM pnl GROUP BY 1, 2 HAVING sum(profit) <> 0"""))
def _(spark, sf):
    d = leg_trades(spark, sf).withColumn("pair", F.concat_ws("_", "n1", "n2"))
    return agg.contract_profit(d, ["scenario"]).select("scenario", "pair", F.round("profit", 6).alias("profit"), "transactions")


@query("a06_scenario_summary", with_(LEG_SQL, """
, c AS (SELECT scenario, n1 || '_' || n2 AS pair, sum(profit) AS profit FROM pnl GROUP BY 1, 2 HAVING sum(profit) <> 0)
SELECT scenario, count(*) AS contracts, round(sum(profit), 6) AS total, round(avg(profit), 4) AS mean, round(stddev_pop(profit), 4) AS std FROM c GROUP BY ROLLUP (scenario)"""))
def _(spark, sf):
    d = leg_trades(spark, sf).withColumn("pair", F.concat_ws("_", "n1", "n2"))
    s = agg.scenario_summary(d, ["scenario"])
    return s.select("scenario", "contracts", F.round("total", 6).alias("total"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("k06_capital_usage", with_(LEG_SQL, """
, ev AS (SELECT scenario, l_orderkey, l_linenumber, l_partkey, l_suppkey, tm_o AS tm, 0 AS kind, -greatest(pos_x * x0, pos_y * y0) AS dc, -least(pos_x * x0, pos_y * y0) AS dm FROM pnl
  UNION ALL SELECT scenario, l_orderkey, l_linenumber, l_partkey, l_suppkey, tm_o + INTERVAL '5 days', 1,
  CASE WHEN pos_x > 0 THEN x1 * pos_x + (y1 - y0) * pos_y ELSE y1 * pos_y + (x1 - x0) * pos_x END - 0.01e0 * (abs(pos_x) + abs(pos_y)), least(pos_x * x0, pos_y * y0) FROM pnl),
d AS (SELECT scenario, tm, sum(dc) AS dc, sum(dm) AS dm FROM ev GROUP BY 1, 2)
SELECT scenario, tm, round(100000 + sum(dc) OVER w, 6) + 0 AS cash, round(sum(dm) OVER w, 6) + 0 AS margin FROM d
WINDOW w AS (PARTITION BY scenario ORDER BY tm ROWS UNBOUNDED PRECEDING)"""))
def _(spark, sf):
    t = leg_trades(spark, sf).withColumn("tm_c", F.col("tm_o") + F.expr("INTERVAL 5 DAYS"))
    d = sg.capital_usage(t, "scenario", 30 * 86_400)
    return d.select("scenario", "tm", F.round("cash", 6).alias("cash"), F.round("margin", 6).alias("margin"))


@query("t04_rank_contracts", with_(CROSS_SQL, """
, r AS (SELECT ts, n1 || '_' || n2 || '_' || CAST(CAST(model_date AS DATE) AS VARCHAR) AS pair, CAST(floor(abs(z)) AS BIGINT) AS rank FROM z)
SELECT ts, pair, rank, row_number() OVER (PARTITION BY ts ORDER BY rank, pair) AS place FROM r WHERE rank <> 0"""))
def _(spark, sf):
    d = simple_z(spark, sf).withColumn("z", F.round("z", 4))
    d = d.select("ts", F.concat_ws("_", "n1", "n2", F.col("model_date").cast("string")).alias("pair"),
                 F.floor(F.abs("z")).cast("bigint").alias("rank"))
    return sg.rank_contracts(d).withColumn("place", F.col("place").cast("bigint"))
