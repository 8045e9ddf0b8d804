"""Pair regression and cointegration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.operators import clean, cointegration as co, regression as rg
from tandem.operators.asof import universe_list
from tandem.plans import feeds
from tandem.plans.adf_sql import PEARSON_SQL, adf_sql, fixed_lag_sql
from tandem.plans.feeds import HORIZONS, panel_sql, with_
from tandem.plans.registry import query

PAIRS_SQL = panel_sql() + """,
pr AS (SELECT a.symbol || '_' || b.symbol AS pair, a.symbol AS n1, b.symbol AS n2, a.ts, a.rn, a.close AS x, b.close AS y
  FROM panel a JOIN panel b ON a.ts = b.ts AND a.symbol < b.symbol)"""

# Residual statistics written the long way: fit, residual series, lags of it.
RESID_SQL = PAIRS_SQL + """,
fit AS (SELECT pair, count(*) AS bars, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, corr(x, y) AS r,
  sum(x * y) / sum(x * x) AS fast_s, arg_max(x, rn) AS x_last, arg_max(y, rn) AS y_last FROM pr GROUP BY pair),
res AS (SELECT p.pair, p.rn, p.x * f.s + f.i - p.y AS e, f.s FROM pr p JOIN fit f ON p.pair = f.pair),
stat AS (SELECT pair, stddev_samp(e) AS st, avg(e) AS m FROM res GROUP BY pair),
lagged AS (SELECT pair, rn, e, lag(e) OVER w AS e1, lead(e) OVER w AS e9 FROM res WINDOW w AS (PARTITION BY pair ORDER BY rn)),
hl AS (SELECT pair, regr_slope(CASE WHEN rn = 0 THEN e9 - e ELSE e - e1 END, CASE WHEN rn = 0 THEN e ELSE e1 END) AS b FROM lagged GROUP BY pair),
tau AS (SELECT pair, k, stddev_pop(d) AS t FROM (SELECT a.pair, k, b.e - a.e AS d FROM generate_series(2, 19) g(k), res a
  JOIN res b ON a.pair = b.pair AND b.rn = a.rn + k) GROUP BY pair, k),
he AS (SELECT pair, regr_slope(ln(t), ln(k)) AS he FROM tau GROUP BY pair)"""


def regressions(spark, sf):
    d = rg.regress_all(feeds.panel(spark, sf))
    return d.withColumn("pair", F.concat_ws("_", "n1", "n2"))


@query("a09_linreg", with_(RESID_SQL, """
SELECT f.pair, bars, round(s, 6) AS s, round(i, 3) AS i, round(r, 6) AS r, round(st, 6) AS st FROM fit f JOIN stat s ON f.pair = s.pair"""))
def _(spark, sf):
    d = regressions(spark, sf)
    return d.select("pair", "bars", F.round("s", 6).alias("s"), F.round("i", 3).alias("i"), F.round("r", 6).alias("r"),
                    F.round("st", 6).alias("st"))


@query("a10_fast_slope", with_(RESID_SQL, """
SELECT p.pair, round(any_value(fast_s), 9) AS fast_s, round(avg(y - fast_s * x), 6) AS fast_i FROM pr p JOIN fit f ON p.pair = f.pair GROUP BY 1"""))
def _(spark, sf):
    return regressions(spark, sf).select("pair", F.round("fast_s", 9).alias("fast_s"), F.round("fast_i", 6).alias("fast_i"))


@query("a11_half_life", with_(RESID_SQL, "SELECT pair, round_even(-ln(2) / b, 2) AS halflife FROM hl"))
def _(spark, sf):
    return regressions(spark, sf).select("pair", "halflife")


@query("a12_hurst", with_(RESID_SQL, "SELECT pair, round(he, 6) AS he FROM he"))
def _(spark, sf):
    return regressions(spark, sf).select("pair", F.round("he", 6).alias("he"))


@query("a13_std_rate", with_(RESID_SQL, """
SELECT f.pair, round(st / (x_last * f.s + y_last) * 100, 6) AS std_rate, round(st / y_last * 100, 6) AS std_y FROM fit f JOIN stat s ON f.pair = s.pair"""))
def _(spark, sf):
    return regressions(spark, sf).select("pair", F.round(rg.std_rate(), 6).alias("std_rate"),
                                         F.round(F.col("st") / F.col("y_last") * 100, 6).alias("std_y"))


TRAILING_SQL = """
win AS (SELECT days, min(rn) AS start_rn, min(ts) AS start_ts FROM (SELECT DISTINCT ts, rn FROM panel), (VALUES {horizons}) h(days)
  WHERE ts >= (SELECT max(ts) FROM panel) - days * INTERVAL '1 day' GROUP BY days),"""


def _johansen_sql(horizons=HORIZONS, win: str = TRAILING_SQL, inside: str = "rn >= start_rn + 2") -> str:
    names = ["x0", "y0", "xz", "yz", "xk", "yk"]
    pick = lambda a, b: "c_%s_%s" % tuple(sorted((a, b), key=names.index))
    covs = ", ".join(f"covar_pop({a}, {b}) AS c_{a}_{b}" for i, a in enumerate(names) for b in names[i:])

    def schur(a, b):  # partial out the two lagged differences
        return (f"({pick(a, b)} - ({pick(a, 'xz')} * ({pick('yz', 'yz')} * {pick('xz', b)} - {pick('xz', 'yz')} * {pick('yz', b)})"
                f" + {pick(a, 'yz')} * ({pick('xz', 'xz')} * {pick('yz', b)} - {pick('xz', 'yz')} * {pick('xz', b)}))"
                f" / ({pick('xz', 'xz')} * {pick('yz', 'yz')} - {pick('xz', 'yz')} * {pick('xz', 'yz')}))")

    s = {n: schur(*n.split("_")) for n in ("x0_x0", "x0_y0", "y0_y0", "xk_x0", "xk_y0", "yk_x0", "yk_y0", "xk_xk", "xk_yk", "yk_yk")}
    schurs = ", ".join(f"{v} AS {k}" for k, v in s.items())
    return PAIRS_SQL + "," + win.format(horizons=", ".join(f"({d})" for d in horizons)) + f"""
seq AS (SELECT p.pair, p.rn, p.ts, x - lag(x) OVER w AS x0, y - lag(y) OVER w AS y0, lag(x) OVER w - lag(x, 2) OVER w AS xz,
  lag(y) OVER w - lag(y, 2) OVER w AS yz, lag(x) OVER w AS xk, lag(y) OVER w AS yk FROM pr p WINDOW w AS (PARTITION BY pair ORDER BY rn)),
mom AS (SELECT pair, days, start_rn, start_ts, count(*) AS t, {covs} FROM seq JOIN win ON {inside} GROUP BY 1, 2, 3, 4),
sch AS (SELECT pair, days, start_rn, start_ts, t, {schurs} FROM mom),
g AS (SELECT *, x0_x0 * y0_y0 - x0_y0 * x0_y0 AS d0, xk_xk * yk_yk - xk_yk * xk_yk AS dk FROM sch),
g2 AS (SELECT *, (xk_x0 * (y0_y0 * xk_x0 - x0_y0 * xk_y0) + xk_y0 * (x0_x0 * xk_y0 - x0_y0 * xk_x0)) / d0 AS gxx,
  (xk_x0 * (y0_y0 * yk_x0 - x0_y0 * yk_y0) + xk_y0 * (x0_x0 * yk_y0 - x0_y0 * yk_x0)) / d0 AS gxy,
  (yk_x0 * (y0_y0 * yk_x0 - x0_y0 * yk_y0) + yk_y0 * (x0_x0 * yk_y0 - x0_y0 * yk_x0)) / d0 AS gyy FROM g),
m AS (SELECT *, (yk_yk * gxx - xk_yk * gxy) / dk AS mxx, (yk_yk * gxy - xk_yk * gyy) / dk AS mxy, (xk_xk * gxy - xk_yk * gxx) / dk AS myx,
  (xk_xk * gyy - xk_yk * gxy) / dk AS myy FROM g2),
ev AS (SELECT *, (mxx + myy) / 2 + sqrt(greatest(pow((mxx + myy) / 2, 2) - (mxx * myy - mxy * myx), 0)) AS l0,
  (mxx + myy) / 2 - sqrt(greatest(pow((mxx + myy) / 2, 2) - (mxx * myy - mxy * myx), 0)) AS l1 FROM m),
js AS (SELECT *, -t * (ln(1 - l0) + ln(1 - l1)) AS trace_0, -t * ln(1 - l1) AS trace_1, -mxy / (l0 - mxx) AS slope,
  CASE WHEN -t * ln(1 - l1) > 3.8415 THEN 2 WHEN -t * (ln(1 - l0) + ln(1 - l1)) > 15.4943 THEN 1 ELSE 0 END AS rank FROM ev)"""


JOHANSEN_SQL = _johansen_sql()


@query("a16_johansen", with_(JOHANSEN_SQL, """
SELECT pair, days, t, round(l0, 7) AS lambda_0, round(l1, 7) AS lambda_1, round(trace_0, 4) AS trace_0, round(trace_1, 4) AS trace_1,
  round(slope, 4) AS slope, rank FROM js"""))
def _(spark, sf):
    d = co.johansen(feeds.panel(spark, sf), HORIZONS)
    return d.select(F.concat_ws("_", "n1", "n2").alias("pair"), "days", "t", F.round("lambda_0", 7).alias("lambda_0"),
                    F.round("lambda_1", 7).alias("lambda_1"), F.round("trace_0", 4).alias("trace_0"),
                    F.round("trace_1", 4).alias("trace_1"), F.round("slope", 4).alias("slope"), "rank")


# Every pair at the end of the panel over one to four weeks, one lag, maximum-eigenvalue statistics.
WEEKS = (7, 14, 21, 28)


@query("a22_all_pair_weeks", with_(_johansen_sql(WEEKS), f"""
SELECT pair, days, t, round(l0, 7) AS lambda_0, round(-t * ln(1 - l0), 4) AS maxeig_0, round(-t * ln(1 - l1), 4) AS maxeig_1, round(slope, 4) AS slope,
  CASE WHEN -t * ln(1 - l1) > {co.MAX_EIGEN_95[1]} THEN 2 WHEN -t * ln(1 - l0) > {co.MAX_EIGEN_95[0]} THEN 1 ELSE 0 END AS relations FROM js"""))
def _(spark, sf):
    d = co.max_eigen_relations(co.johansen(feeds.panel(spark, sf), WEEKS))
    return d.select(F.concat_ws("_", "n1", "n2").alias("pair"), "days", "t", F.round("lambda_0", 7).alias("lambda_0"), F.round("maxeig_0", 4).alias("maxeig_0"),
                    F.round("trace_1", 4).alias("maxeig_1"), F.round("slope", 4).alias("slope"), "relations")


# Loose limits: the test data are independent draws, so tight ones leave nothing.
JS_LIMITS = dict(max_hurst=0.9, max_halflife_hours=500.0)


def js(spark, sf):
    return co.js_candidates(feeds.panel(spark, sf), HORIZONS, interval_secs=600.0, **JS_LIMITS)


@query("a18_js_candidates", with_(JOHANSEN_SQL, """
, best AS (SELECT * FROM js WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY pair ORDER BY l0 DESC, days) = 1),
w AS (SELECT p.*, b.start_rn, b.days, b.slope AS s_0 FROM pr p JOIN best b ON p.pair = b.pair AND p.rn >= b.start_rn),
fit AS (SELECT pair, any_value(days) AS coint_days, any_value(s_0) AS s_0, any_value(start_rn) AS start_rn, regr_slope(y, x) AS s, regr_intercept(y, x) AS i,
  sum(x * y) / sum(x * x) AS fast, arg_max(x, rn) AS xl, arg_max(y, rn) AS yl FROM w GROUP BY pair),
res AS (SELECT w.pair, w.rn - w.start_rn AS k0, x * f.s + f.i - y AS e FROM w JOIN fit f ON w.pair = f.pair),
st AS (SELECT pair, stddev_samp(e) AS st FROM res GROUP BY pair),
lagged AS (SELECT pair, k0, e, lag(e) OVER v AS e1, lead(e) OVER v AS e9 FROM res WINDOW v AS (PARTITION BY pair ORDER BY k0)),
hl AS (SELECT pair, round_even(-ln(2) / regr_slope(CASE WHEN k0 = 0 THEN e9 - e ELSE e - e1 END, CASE WHEN k0 = 0 THEN e ELSE e1 END), 2) AS hl
  FROM lagged GROUP BY pair),
he AS (SELECT pair, regr_slope(ln(t), ln(k)) AS he FROM (SELECT a.pair, k, stddev_pop(b.e - a.e) AS t FROM generate_series(2, 19) g(k), res a
  JOIN res b ON a.pair = b.pair AND b.k0 = a.k0 + k GROUP BY 1, 2) GROUP BY pair),
two AS (SELECT p.pair, regr_slope(y, x) AS s2, sum(x * y) / sum(x * x) AS f2 FROM pr p JOIN hl ON p.pair = hl.pair AND hl.hl > 0
  WHERE p.rn >= (SELECT max(rn) + 1 FROM panel) - round_even(hl.hl, 0) GROUP BY 1)
SELECT fit.pair, coint_days, round(s_0, 4) AS s_0, round(s, 5) AS s_dayslr, round(fast, 6) AS s_daysfast, round(s2, 5) AS s_hllr, round(f2, 6) AS s_hlfast,
  round(st / (xl * s + yl) * 100, 6) AS std_rate, round(he, 5) AS he_0, hl AS hl_bars_0
FROM fit JOIN st USING (pair) JOIN hl USING (pair) JOIN he USING (pair) JOIN two USING (pair)
WHERE xl >= 5 AND yl >= 5 AND he <= 0.9 AND hl > 0 AND hl * 600 / 3600 <= 500 AND least(s_0, s, fast, s2, f2) >= 0.01"""))
def _(spark, sf):
    d = js(spark, sf)
    return d.select("pair", "coint_days", F.round("s_0", 4).alias("s_0"), F.round("s_dayslr", 5).alias("s_dayslr"),
                    F.round("s_daysfast", 6).alias("s_daysfast"), F.round("s_hllr", 5).alias("s_hllr"),
                    F.round("s_hlfast", 6).alias("s_hlfast"), F.round("std_rate", 6).alias("std_rate"),
                    F.round("he_0", 5).alias("he_0"), "hl_bars_0")


# Residuals of every pair and horizon: the first leg on the second and a constant; g names the series.
HORIZON_RESID_SQL = PAIRS_SQL + f""",
win AS (SELECT days, min(rn) AS start_rn, min(ts) AS start_ts FROM (SELECT DISTINCT ts, rn FROM panel), (VALUES {', '.join(f'({d})' for d in HORIZONS)}) h(days)
  WHERE ts >= (SELECT max(ts) FROM panel) - days * INTERVAL '1 day' GROUP BY days),
hp AS (SELECT pair || '|' || days AS g, pair, days, start_ts, rn - start_rn AS k, x, y FROM pr JOIN win ON rn >= start_rn),
hfit AS (SELECT g, regr_slope(x, y) AS b, regr_intercept(x, y) AS a FROM hp GROUP BY g),
resid AS (SELECT hp.g, k, x - b * y - a AS e FROM hp JOIN hfit ON hp.g = hfit.g)"""

GRANGER_SQL = "WITH RECURSIVE " + (HORIZON_RESID_SQL + adf_sql("resid", "eg")).strip() + """,
hs AS (SELECT g, any_value(pair) AS pair, any_value(days) AS days, any_value(start_ts) AS start_ts FROM hp GROUP BY g),
cand AS (SELECT pair, """ + ", ".join(f"max(CASE WHEN days = {d} THEN p END) AS p_{d}" for d in HORIZONS) + """,
  avg(p) AS p, min(p) AS pmin, arg_min(start_ts, ROW(p, days)) AS start_of_pmin FROM eg JOIN hs ON eg.g = hs.g GROUP BY pair)
"""


def _p(*names, n=8):
    return [F.round(c, n).alias(c) for c in names]


def _p_sql(*names, n=8):
    return ", ".join(f"round({c}, {n}) AS {c}" for c in names)


P_HORIZONS = [f"p_{d}" for d in HORIZONS]


@query("a14_engle_granger", GRANGER_SQL + f"SELECT pair, {_p_sql(*P_HORIZONS)} FROM cand")
def _(spark, sf):
    return co.coint_candidates(feeds.panel(spark, sf), HORIZONS).select("pair", *_p(*P_HORIZONS))


T_HORIZONS = [f"t_{d}" for d in HORIZONS]


@query("a14_adf_fixed_lags", with_(HORIZON_RESID_SQL + fixed_lag_sql("resid", "zero", 0) + fixed_lag_sql("resid", "one", 1), """
SELECT split_part(z.g, '|', 1) AS pair, 0 AS lag, """ + ", ".join(f"round(max(CASE WHEN split_part(z.g, '|', 2) = '{d}' THEN z.tau END), 6) AS t_{d}" for d in HORIZONS) + """ FROM zero z GROUP BY 1
UNION ALL SELECT split_part(z.g, '|', 1), 1, """ + ", ".join(f"round(max(CASE WHEN split_part(z.g, '|', 2) = '{d}' THEN z.tau END), 6)" for d in HORIZONS) + " FROM one z GROUP BY 1"))
def _(spark, sf):
    both = [co.coint_at_lag(feeds.panel(spark, sf), k, HORIZONS).withColumn("lag", F.lit(k)) for k in (0, 1)]
    return both[0].unionByName(both[1]).select(F.concat_ws("_", "n1", "n2").alias("pair"), "lag", *_p(*T_HORIZONS, n=6))


# Whole panel: stationarity of the legs, correlation, cointegration.
TESTS_SQL = "WITH RECURSIVE " + (PAIRS_SQL + """,
legs AS (SELECT symbol AS g, rn - min(rn) OVER (PARTITION BY symbol) AS k, close - avg(close) OVER (PARTITION BY symbol) AS e FROM panel),
wfit AS (SELECT pair, regr_slope(x, y) AS b, regr_intercept(x, y) AS a FROM pr GROUP BY pair),
resid AS (SELECT pr.pair AS g, rn AS k, x - b * y - a AS e FROM pr JOIN wfit ON pr.pair = wfit.pair)"""
                               + adf_sql("legs", "own", constant=True, surface=1) + adf_sql("resid", "eg")).strip() + f""",
rs AS (SELECT n1, n2, any_value(pair) AS pair, count(*) AS n, corr(x, y) AS r FROM pr GROUP BY n1, n2),
tests AS (SELECT n1, n2, a.p AS p_x, b.p AS p_y, r AS corr, greatest(0e0, {PEARSON_SQL}) AS p_corr, eg.p AS p_coint
  FROM rs JOIN own a ON a.g = n1 JOIN own b ON b.g = n2 JOIN eg ON eg.g = pair)
"""
TESTED = ["p_x", "p_y", "corr", "p_corr", "p_coint"]


@query("a15_pair_tests", TESTS_SQL + f"SELECT n1, n2, {_p_sql(*TESTED)} FROM tests")
def _(spark, sf):
    return co.pair_tests(feeds.panel(spark, sf)).select("n1", "n2", *_p(*TESTED))


@query("a17_coint_candidates", GRANGER_SQL + f"SELECT pair, {_p_sql(*P_HORIZONS, 'p', 'pmin')}, start_of_pmin FROM cand ORDER BY cand.p, pair LIMIT 100")
def _(spark, sf):
    top = co.top_pairs(co.coint_candidates(feeds.panel(spark, sf), HORIZONS))
    return top.select("pair", *_p(*P_HORIZONS, "p", "pmin"), "start_of_pmin")


@query("t01_top_pairs", with_(RESID_SQL, """
SELECT f.pair, round(1 - abs(r), 6) AS p FROM fit f ORDER BY 1 - abs(r), f.pair LIMIT 7"""))
def _(spark, sf):
    d = regressions(spark, sf).select("pair", (1 - F.abs("r")).alias("p"))
    return co.top_pairs(d, 7).select("pair", F.round("p", 6).alias("p"))


def candidates(spark, sf):
    """Candidate rows that start at different times, from native statistics."""
    d = co.johansen(feeds.panel(spark, sf), HORIZONS)
    best = d.groupBy("n1", "n2").agg(F.max_by("start_ts", F.struct("lambda_0", -F.col("days"))).alias("start_of_pmin"),
                                     F.max("lambda_0").alias("p"))
    return best.select(F.concat_ws("_", "n1", "n2").alias("pair"), "start_of_pmin", "p")


@query("a19_ols_models", with_(JOHANSEN_SQL, """
, cand AS (SELECT pair, arg_max(start_rn, ROW(l0, -days)) AS start_rn FROM js GROUP BY pair),
w AS (SELECT p.*, c.start_rn FROM pr p JOIN cand c ON p.pair = c.pair AND p.rn >= c.start_rn),
fit AS (SELECT pair, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM w GROUP BY pair),
res AS (SELECT w.pair, w.rn - w.start_rn AS k0, x * f.s + f.i - y AS e FROM w JOIN fit f ON w.pair = f.pair),
st AS (SELECT pair, stddev_samp(e) AS st FROM res GROUP BY pair),
lagged AS (SELECT pair, k0, e, lag(e) OVER v AS e1, lead(e) OVER v AS e9 FROM res WINDOW v AS (PARTITION BY pair ORDER BY k0)),
hl AS (SELECT pair, round_even(-ln(2) / regr_slope(CASE WHEN k0 = 0 THEN e9 - e ELSE e - e1 END, CASE WHEN k0 = 0 THEN e ELSE e1 END), 2) AS hl
  FROM lagged GROUP BY pair),
he AS (SELECT pair, regr_slope(ln(t), ln(k)) AS he FROM (SELECT a.pair, k, stddev_pop(b.e - a.e) AS t FROM generate_series(2, 19) g(k), res a
  JOIN res b ON a.pair = b.pair AND b.k0 = a.k0 + k GROUP BY 1, 2) GROUP BY pair)
SELECT pair, round(s, 5) AS s, round(i, 2) AS i, round(st, 6) AS st, hl AS halflife, round(he, 5) AS HE
FROM fit JOIN st USING (pair) JOIN hl USING (pair) JOIN he USING (pair)"""))
def _(spark, sf):
    d = rg.ols_models(feeds.panel(spark, sf), candidates(spark, sf))
    return d.select("pair", F.round("s", 5).alias("s"), F.round("i", 2).alias("i"), F.round("st", 6).alias("st"),
                    "halflife", F.round("HE", 5).alias("HE"))


def ols(spark, sf):
    return rg.ols_models(feeds.panel(spark, sf), candidates(spark, sf))


@query("p17_filter_models_ols", with_(RESID_SQL, "SELECT pair, round(s, 6) AS s FROM fit WHERE s > 0.05"))
def _(spark, sf):
    d = regressions(spark, sf).withColumn("start_of_pmin", F.col("start"))
    return clean.filter_models_ols(d).select("pair", F.round("s", 6).alias("s"))


@query("p16_filter_models_v0", with_(RESID_SQL, """
SELECT pair FROM hl JOIN he USING (pair) WHERE he <= 0.45 AND round_even(-ln(2) / b, 2) * 60 <= 21600"""))
def _(spark, sf):
    d = regressions(spark, sf).withColumnRenamed("he", "HE").withColumn("halflife_secs", F.col("halflife") * 60)
    return clean.filter_models_v0(d).select("pair")


@query("p15_filter_models_v1", with_(RESID_SQL, """
, k AS (SELECT f.pair, k, s * (0.55e0 + 0.1e0 * k) AS s_0, s AS s_dayslr, round_even(-ln(2) / b, 2) AS hl, 10e0 * k AS secs, abs(r) / k AS pxy, abs(r) / 9 AS pyx
  FROM fit f JOIN hl ON f.pair = hl.pair, generate_series(1, 9) g(k))
SELECT pair, k, round(s_dayslr, 6) AS slope FROM k WHERE abs((s_0 - s_dayslr) / s_dayslr) <= 0.3 AND floor(hl * secs) >= 2040 AND pxy <= 0.1 AND pyx <= 0.1"""))
def _(spark, sf):
    d = regressions(spark, sf).select("pair", F.col("s").alias("s_dayslr"), F.col("halflife").alias("hl_bars_0"), "r",
                                      F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(9).cast("bigint"))).alias("k"))
    d = d.withColumns({"s_0": F.col("s_dayslr") * (0.55 + 0.1 * F.col("k")), "interval_secs": 10.0 * F.col("k"),
                       "pxy": F.abs("r") / F.col("k"), "pyx": F.abs("r") / 9})
    return clean.filter_models_v1(d).select("pair", "k", F.round("slope", 6).alias("slope"))


@query("p18_filter_models_js", with_(RESID_SQL, """
, k AS (SELECT f.pair, split_part(f.pair, '_', 1) AS n1, k, s * k / 5 AS s_0, s, fast_s, round_even(-ln(2) / b, 2) * 60 * k / 3600 AS hours, he + (k - 5) * 0.05 AS he, x_last, y_last
  FROM fit f JOIN hl USING (pair) JOIN he USING (pair), generate_series(1, 9) g(k))
SELECT pair, k FROM k WHERE x_last >= 5 AND y_last >= 5 AND he <= 0.49 AND hours > 0 AND hours <= 6.5 AND s_0 >= 0.01 AND s >= 0.01 AND fast_s >= 0.01
  AND pair NOT LIKE '%view%'"""))
def _(spark, sf):
    d = regressions(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(9).cast("bigint"))))
    d = d.select("pair", "n1", "n2", "k", "x_last", "y_last", (F.col("s") * F.col("k") / 5).alias("s_0"),
                 F.col("s").alias("s_dayslr"), F.col("fast_s").alias("s_daysfast"), F.col("s").alias("s_hllr"),
                 F.col("fast_s").alias("s_hlfast"), (F.col("he") + (F.col("k") - 5) * 0.05).alias("he_0"),
                 F.col("halflife").alias("hl_bars_0"), (60.0 * F.col("k")).alias("interval_secs"))
    return clean.filter_models_js(d, ignored=["view"]).select("pair", "k")


@query("a26_money_coeff", with_(RESID_SQL, """
, r AS (SELECT f.pair, st / (x_last * f.s + y_last) * 100 AS std_rate FROM fit f JOIN stat s ON f.pair = s.pair)
SELECT split_part(pair, '_', 1) AS n1, round(sqrt(max(std_rate) * min(std_rate)), 7) AS coeff FROM r GROUP BY 1"""))
def _(spark, sf):
    from tandem.operators.aggregates import money_coeff
    d = regressions(spark, sf).withColumn("std_rate", rg.std_rate())
    return money_coeff(d, ["n1"]).select("n1", F.round("coeff", 7).alias("coeff"))


@query("a20_coint_study")
def _(spark, sf):
    return co.coint_study(feeds.panel(spark, sf), max_p=0.2)


#: The symbols of the given events.
SYMBOLS = ["click", "error", "purchase", "signup", "view"]


@query("a21_coint_matrix", TESTS_SQL + ", half AS (SELECT n1, n2, p_coint AS p FROM tests UNION ALL SELECT n2, n1, p_coint FROM tests) SELECT n1 AS symbol, "
       + ", ".join(f"CASE WHEN n1 = '{c}' THEN 0e0 ELSE round(max(CASE WHEN n2 = '{c}' THEN p END), 8) END AS {c}" for c in SYMBOLS) + " FROM half GROUP BY n1")
def _(spark, sf):
    p = feeds.panel(spark, sf)
    names = universe_list(p)
    return co.coint_matrix(co.pair_tests(p), names).select("symbol", *_p(*names))


@query("a21_coint_pairs", TESTS_SQL + "SELECT n1, n2, round(p_coint, 8) AS p FROM tests WHERE p_coint <= 0.05 ORDER BY p_coint, n1, n2")
def _(spark, sf):
    return co.coint_pairs(co.pair_tests(feeds.panel(spark, sf))).select("n1", "n2", *_p("p"))


@query("a22_rolling_johansen")
def _(spark, sf):
    return co.rolling_johansen(feeds.panel(spark, sf))


# Windows of 10, 20 and 30 days that end at every hour, up to 48 hours before the last bar; start_ts carries the end.
HOURLY_SQL = """
win AS (SELECT days, min(rn) AS start_rn, e AS start_ts FROM (SELECT DISTINCT ts, rn FROM panel), (VALUES {horizons}) h(days),
    (SELECT unnest(generate_series(date_trunc('hour', min(ts)), max(ts) - INTERVAL '48 hours', INTERVAL '1 hour')) AS e FROM panel)
  WHERE e - days * INTERVAL '1 day' >= (SELECT date_trunc('day', min(ts)) FROM panel) AND ts >= e - days * INTERVAL '1 day' AND ts <= e GROUP BY days, e
  HAVING count(*) >= 24),"""


@query("a22_rolling_johansen_one_lag", with_(_johansen_sql((10, 20, 30), HOURLY_SQL, "rn >= start_rn + 2 AND ts <= start_ts"), """
SELECT pair, days, start_ts AS "end", round(l0, 5) AS lambda_0, round(-t * ln(1 - l0), 2) AS maxeig_0 FROM js"""))
def _(spark, sf):
    d = co.rolling_johansen(feeds.panel(spark, sf), lags=[1], all_windows=True)
    return d.select(F.concat_ws("_", "n1", "n2").alias("pair"), "days", "end", F.round("lambda_0", 5).alias("lambda_0"), F.round("maxeig_0", 2).alias("maxeig_0"))
