"""Fees, text and date expressions, return distributions and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandem.functions import fees, timeline
from tandem.functions.pricing import norm_cdf
from tandem.operators import clusters as cl, distribution as di, options as op
from tandem.operators.features import fwd_return
from tandem.plans import feeds
from tandem.plans.feeds import POSITIONS_SQL, WEEKLY_SQL, bars_sql, with_
from tandem.plans.option_plans import cdf_sql
from tandem.plans.registry import query


def _pos(spark, sf):
    return feeds.positions(spark, sf)


Q, P = "qty", "cost_price"


@query("e01_clip", "SELECT event_id, greatest(least(value, 400), 10.5) AS clipped, greatest(value, 1.99) AS low, least(value, 5.95) AS high FROM events")
def _(spark, sf):
    v = F.col("value")
    return feeds.table(spark, sf, "events").select("event_id", fees.clip(v, 10.5, 400.0).alias("clipped"), fees.clip(v, 1.99).alias("low"),
                                                   fees.clip(v, None, 5.95).alias("high"))


@query("e02_us_commission", with_(POSITIONS_SQL, """
SELECT position_id, round(greatest(0.01 * qty, 1.99), 6) AS v0, round(greatest(0.005 * qty, 1) + greatest(0.0049 * qty, 0.99), 6) AS v1,
  round(greatest(0.01 * qty, 1) + greatest(0.0049 * qty, 0.99), 6) AS v2 FROM positions"""))
def _(spark, sf):
    return _pos(spark, sf).select("position_id", *[F.round(fees.us_commission(F.col(Q), p), 6).alias(p) for p in ("v0", "v1", "v2")])


@query("e03_us_regulatory", with_(POSITIONS_SQL, """
SELECT position_id, 0.003e0 * qty + CASE WHEN position_id % 3 = 0 THEN greatest(qty * cost_price * 0.0000051e0, 0.01e0) + least(greatest(0.000119e0 * qty, 0.01e0), 5.95e0) ELSE 0e0 END AS fee FROM positions"""))
def _(spark, sf):
    sell = F.col("position_id") % 3 == 0
    return _pos(spark, sf).select("position_id", fees.us_regulatory(F.col(Q), F.col(P), sell).alias("fee"))


@query("e04_hk_commission", with_(POSITIONS_SQL, """
SELECT position_id, round(20 + greatest(0.0003e0 * (qty * cost_price), 3), 7) AS fee FROM positions"""))
def _(spark, sf):
    return _pos(spark, sf).select("position_id", F.round(fees.hk_commission(F.col(Q) * F.col(P)), 7).alias("fee"))


HK_SQL = """(0.5e0 + least(greatest(0.00002e0 * (qty * cost_price), 2e0), 100e0) + ceil({rate}e0 * (qty * cost_price)) + greatest(0.00005e0 * (qty * cost_price), 0.01e0)
  + greatest(0.000027e0 * (qty * cost_price), 0.01e0))"""


@query("e05_hk_regulatory", with_(POSITIONS_SQL, f"""
SELECT position_id, {HK_SQL.format(rate='0.001')} AS fee, {HK_SQL.format(rate='0.0013')} AS fee_after FROM positions"""))
def _(spark, sf):
    q, p = F.col(Q), F.col(P)
    return _pos(spark, sf).select("position_id", fees.hk_regulatory(q, p).alias("fee"),
                                  fees.hk_regulatory(q, p, fees.HK_STAMP_AFTER).alias("fee_after"))


@query("e06_breakeven", with_(POSITIONS_SQL, f"""
, f AS (SELECT *, {HK_SQL.format(rate='0.001')} + (20e0 + greatest(0.0003e0 * (qty * cost_price), 3e0)) AS one,
  0.003e0 * qty + (greatest(qty * cost_price * 0.0000051e0, 0.01e0) + least(greatest(0.000119e0 * qty, 0.01e0), 5.95e0)) + greatest(0.01e0 * qty, 1.99e0) AS us FROM positions)
SELECT position_id, 4 * one AS fee, 2 * one / qty + cost_price AS low_price, 4 * us AS us_fee, 2 * us / qty + cost_price AS us_low_price FROM f"""))
def _(spark, sf):
    q, p = F.col(Q), F.col(P)
    d = fees.breakeven(_pos(spark, sf), fees.hk_fee(q, p)).withColumnsRenamed({"fee": "hk", "low_price": "hk_low"})
    d = fees.breakeven(d, fees.us_fee(q, p, F.lit(True)))
    return d.select("position_id", F.col("hk").alias("fee"), F.col("hk_low").alias("low_price"),
                    F.col("fee").alias("us_fee"), F.col("low_price").alias("us_low_price"))


@query("e13_ib_time", """
SELECT event_id, date_trunc('second', ts) AS ts, strftime(ts, '%Y%m%d  %H:%M:%S') AS text FROM events""")
def _(spark, sf):
    e = feeds.table(spark, sf, "events")
    text = F.date_format("ts", "yyyyMMdd   HH:mm:ss")
    return e.select("event_id", timeline.ib_time(text).alias("ts"), timeline.format_ib_time(timeline.ib_time(text)).alias("text"))


@query("e16_date_range", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 59, '%Y-%m-%d') AS start_date, strftime(CAST(o_orderdate AS DATE) + 1, '%Y-%m-%d') AS end_date FROM orders""")
def _(spark, sf):
    a, z = op.date_range(F.to_date("o_orderdate"), 59)
    return feeds.table(spark, sf, "orders").select("o_orderkey", a.alias("start_date"), z.alias("end_date"))


@query("s05_shard_of", """
WITH h AS (SELECT DISTINCT c_name AS symbol, sha1(c_name) AS h FROM customer),
d AS (SELECT symbol, h, list_sum(list_transform(string_split(substr(h, 1, 39), ''), lambda c: instr('0123456789abcdef', c) - 1)) AS s FROM h)
SELECT symbol, CAST(((instr('0123456789abcdef', substr(h, 40, 1)) - 1) + 16 * CAST(s AS BIGINT)) % 20 AS BIGINT) AS shard FROM d""")
def _(spark, sf):
    from tandem.sources.bars import shard_of
    return feeds.table(spark, sf, "customer").select(F.col("c_name").alias("symbol"), shard_of(F.col("c_name")).alias("shard"))


@query("a23_return_distribution", with_(bars_sql(), f"""
, m AS (SELECT symbol, rn, (high + low) / 2 AS m FROM bars),
f AS (SELECT symbol, rn, lead(m) OVER (PARTITION BY symbol ORDER BY rn) / m AS r FROM m),
u AS (SELECT symbol, avg(r) AS u FROM f GROUP BY 1),
r AS (SELECT f.symbol, coalesce(r, u) AS r FROM f JOIN u ON f.symbol = u.symbol),
s AS (SELECT symbol, count(*) AS n, avg(r) AS mean, stddev_pop(r) AS std, quantile_cont(r, 0.5) AS loc FROM r GROUP BY 1),
s2 AS (SELECT r.symbol, any_value(n) AS n, any_value(mean) AS mean, any_value(std) AS std, any_value(loc) AS loc, avg(abs(r - loc)) AS scale,
  avg(pow(r - mean, 3)) / pow(any_value(std), 3) AS skew, avg(pow(r - mean, 4)) / pow(any_value(std), 4) - 3 AS kurtosis FROM r JOIN s ON r.symbol = s.symbol GROUP BY 1),
k AS (SELECT r.symbol, r, (r - mean) / std AS z, (r - loc) / scale AS l, n, rank() OVER w - 1 AS below, count(*) OVER (PARTITION BY r.symbol ORDER BY r RANGE UNBOUNDED PRECEDING) AS upto
  FROM r JOIN s2 ON r.symbol = s2.symbol WINDOW w AS (PARTITION BY r.symbol ORDER BY r)),
k2 AS (SELECT *, {cdf_sql('z')} AS fn, CASE WHEN l < 0 THEN exp(l) / 2 ELSE 1 - exp(-l) / 2 END AS fl FROM k),
ks AS (SELECT symbol, max(greatest(upto / n - fn, fn - below / n)) AS ks_normal, max(greatest(upto / n - fl, fl - below / n)) AS ks_laplace FROM k2 GROUP BY 1),
t0 AS (SELECT *, CAST(n AS DOUBLE) AS x FROM s2),
t1 AS (SELECT *, skew * sqrt((x + 1) * (x + 3) / (6 * (x - 2))) AS y, -1 + sqrt(2 * (3 * (x * x + 27 * x - 70) * (x + 1) * (x + 3) / ((x - 2) * (x + 5) * (x + 7) * (x + 9)) - 1)) AS w2,
  (kurtosis + 3 - 3 * (x - 1) / (x + 1)) / sqrt(24 * x * (x - 2) * (x - 3) / ((x + 1) * (x + 1) * (x + 3) * (x + 5))) AS kx,
  6 * (x * x - 5 * x + 2) / ((x + 7) * (x + 9)) * sqrt(6 * (x + 3) * (x + 5) / (x * (x - 2) * (x - 3))) AS rt FROM t0),
t2 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS a FROM t1),
t3 AS (SELECT *, (1 - 2 / (9 * a) - sign(1 + kx * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + kx * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM t2)
SELECT t.symbol, n, round(mean, 9) AS mean, round(std, 9) AS std, round(loc, 9) AS loc, round(scale, 9) AS scale, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis,
  round(ks_normal, 7) AS ks_normal, round(ks_laplace, 7) AS ks_laplace, round(zs * zs + zk * zk, 3) AS k2 FROM t3 t JOIN ks ON t.symbol = ks.symbol"""))
def _(spark, sf):
    b = feeds.bars(spark, sf)
    d = di.return_distribution(fwd_return(b, (F.col("high") + F.col("low")) / 2))
    return d.select("symbol", "n", *[F.round(c, 9).alias(c) for c in ("mean", "std", "loc", "scale")], F.round("skew", 5).alias("skew"),
                    F.round("kurtosis", 5).alias("kurtosis"), F.round("ks_normal", 7).alias("ks_normal"),
                    F.round("ks_laplace", 7).alias("ks_laplace"), F.round("k2", 3).alias("k2"))


GAMMA = 0.0005
FEATURES_SQL = WEEKLY_SQL + """,
ft AS (SELECT symbol, ts, """ + ", ".join(f"coalesce(ln({f} / lag({f}) OVER w), 0) AS r_{f}" for f in cl.FIELDS) + """
  FROM weekly WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
grid AS (SELECT symbol, ts FROM (SELECT DISTINCT symbol FROM ft), (SELECT DISTINCT ts FROM ft)),
zf AS (SELECT symbol, ts, """ + ", ".join(f"coalesce(r_{f}, 0) AS r_{f}" for f in cl.FIELDS) + """ FROM grid LEFT JOIN ft USING (symbol, ts)),
dist AS (SELECT a.symbol AS a, b.symbol AS b, sum(""" + " + ".join(f"pow(a.r_{f} - b.r_{f}, 2)" for f in cl.FIELDS) + """) AS d2
  FROM zf a JOIN zf b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2)"""


def _features(spark, sf):
    return feeds.stored(spark, sf, "features", lambda: cl.return_features(feeds.weekly(spark, sf)))


def _distances(spark, sf):
    return feeds.stored(spark, sf, "distances", lambda: cl.squared_distances(_features(spark, sf)))


@query("a24_affinity", with_(FEATURES_SQL, f"SELECT a, b, round(d2, 5) AS d2, round(exp(-{GAMMA} * d2), 8) AS weight FROM dist"))
def _(spark, sf):
    d = cl.affinity(_distances(spark, sf), GAMMA)
    return d.select("a", "b", F.round("d2", 5).alias("d2"), F.round("weight", 8).alias("weight"))


@query("a24_cluster_symbols")
def _(spark, sf):
    return cl.cluster_lists(cl.cluster_symbols(_distances(spark, sf), 4, GAMMA))


# A fixed assignment by name lets the scores be checked in SQL.
SCORES_SQL = FEATURES_SQL + """,
asg AS (SELECT DISTINCT symbol, CAST(regexp_extract(symbol, '[0-9]+') AS INTEGER) // 7 AS cluster FROM ft),
f AS (SELECT ft.*, cluster FROM ft JOIN asg USING (symbol)),
cen AS (SELECT cluster, ts, """ + ", ".join(f"avg(r_{x}) AS m_{x}" for x in cl.FIELDS) + """ FROM f GROUP BY 1, 2),
wi AS (SELECT f.cluster, symbol, sum(""" + " + ".join(f"pow(r_{x} - m_{x}, 2)" for x in cl.FIELDS) + """) AS d2 FROM f JOIN cen ON f.cluster = cen.cluster AND f.ts = cen.ts GROUP BY 1, 2),
per AS (SELECT cluster, count(*) AS size, avg(sqrt(d2)) AS s, sum(d2) AS w FROM wi GROUP BY 1),
who AS (SELECT ts, """ + ", ".join(f"avg(r_{x}) AS g_{x}" for x in cl.FIELDS) + """ FROM ft GROUP BY 1),
bet AS (SELECT cluster, sum(""" + " + ".join(f"pow(m_{x} - g_{x}, 2)" for x in cl.FIELDS) + """) AS g2 FROM cen JOIN who USING (ts) GROUP BY 1),
ch AS (SELECT count(*) AS k, (sum(size * g2) / (count(*) - 1)) / (sum(w) / (sum(size) - count(*))) AS ch FROM per JOIN bet USING (cluster)),
ap AS (SELECT i.cluster AS i, j.cluster AS j, sqrt(sum(""" + " + ".join(f"pow(i.m_{x} - j.m_{x}, 2)" for x in cl.FIELDS) + """)) AS m FROM cen i JOIN cen j ON i.ts = j.ts AND i.cluster <> j.cluster GROUP BY 1, 2),
db AS (SELECT avg(r) AS db FROM (SELECT i, max((a.s + b.s) / m) AS r FROM ap JOIN per a ON a.cluster = i JOIN per b ON b.cluster = j GROUP BY 1)),
both_ AS (SELECT a, b, sqrt(d2) AS d FROM dist UNION ALL SELECT b, a, sqrt(d2) FROM dist),
mn AS (SELECT a, x.cluster AS ca, y.cluster AS cb, avg(d) AS m FROM both_ JOIN asg x ON x.symbol = a JOIN asg y ON y.symbol = b GROUP BY 1, 2, 3),
si AS (SELECT a, max(CASE WHEN ca = cb THEN m END) AS n, min(CASE WHEN ca <> cb THEN m END) AS o FROM mn GROUP BY 1),
sl AS (SELECT avg(CASE WHEN n IS NULL OR o IS NULL THEN 0 ELSE (o - n) / greatest(o, n) END) AS s FROM si),
sz AS (SELECT list(size ORDER BY size DESC) AS l FROM (SELECT DISTINCT size FROM per))
SELECT k, round(ch, 6) AS calinski_harabasz, round(db, 6) AS davies_bouldin, round(s, 7) AS silhouette, l[1] / l[least(len(l), 5)] AS size_ratio FROM ch, db, sl, sz"""


@query("a25_cluster_scores", with_(SCORES_SQL))
def _(spark, sf):
    f = _features(spark, sf)
    number = F.regexp_extract("symbol", "[0-9]+", 0).cast("int")
    assigned = f.select("symbol").distinct().withColumn("cluster", F.floor(number / 7).cast("int"))
    d = cl.cluster_scores(assigned, f, _distances(spark, sf))
    return d.select("k", F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"),
                    F.round("silhouette", 7).alias("silhouette"), "size_ratio")


@query("a25_best_k")
def _(spark, sf):
    return cl.best_k(_features(spark, sf), _distances(spark, sf), range(2, 25), GAMMA)
