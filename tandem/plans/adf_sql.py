"""SQL twins of the tests with a search over lags: lists of lagged values, their products, and elimination."""

from __future__ import annotations

from tandem.operators.cointegration import MACKINNON
from tandem.plans.option_plans import cdf_sql


def adf_sql(series: str, name: str, constant: bool = False, surface: int = 2) -> str:
    """CTEs that end in ``name(g, tau, p)`` from ``series(g, k, e)``: k counts the rows of a series from 0.

    Products of the lagged lists make one matrix; each elimination step takes one more regressor in, and what is left
    of the last diagonal element is the residual sum with the regressors so far.
    """
    fixed = int(constant)
    k = MACKINNON[surface]
    centre = "list_transform({0}, lambda v: v - list_avg({0}))" if constant else "{0}"
    matrix = "list_transform(vs, lambda u: list_transform(vs, lambda w: list_inner_product(u, w)))"
    step = ("list_transform(range(1, len(mat) + 1), lambda i: list_transform(range(1, len(mat) + 1), "
            "lambda j: mat[i][j] - mat[i][s + 1] * mat[s + 1][j] / mat[s + 1][s + 1]))")
    poly = lambda c: " + ".join(f"{v}e0 * pow(tau, {j})" for j, v in enumerate(c))
    return f""",
{name}_a AS (SELECT g, count(*) AS n, list(e ORDER BY k) AS lev FROM {series} GROUP BY g),
{name}_b AS (SELECT *, list_transform(range(1, n), lambda t: lev[t + 1] - lev[t]) AS dif,
  least(CAST(ceil(12 * pow(n / 100e0, 0.25)) AS BIGINT), n // 2 - {fixed + 1}, (n - {4 + fixed}) // 2) AS top FROM {name}_a),
{name}_c AS (SELECT g, n, top, list_transform(list_concat([lev[top + 1:n - 1]], list_transform(range(1, top + 1), lambda j: dif[top + 1 - j:n - 1 - j]), [dif[top + 1:n - 1]]),
  lambda l: {centre.format('l')}) AS vs FROM {name}_b),
{name}_m AS (SELECT g, n - top - 1 AS nobs, top, {matrix} AS mat FROM {name}_c),
{name}_e AS (SELECT g, nobs, top, 0 AS s, mat FROM {name}_m UNION ALL
  SELECT g, nobs, top, s + 1, {step} FROM {name}_e WHERE s <= top),
{name}_l AS (SELECT g, arg_min(s - 1, ROW(nobs * ln(mat[top + 2][top + 2] / nobs) + 2 * (s + {fixed}), s)) AS lag FROM {name}_e WHERE s >= 1 GROUP BY g),
{name}_f AS (SELECT b.g, n, lag, list_transform(list_concat(list_transform(range(1, lag + 1), lambda j: dif[lag + 1 - j:n - 1 - j]), [lev[lag + 1:n - 1]], [dif[lag + 1:n - 1]]),
  lambda l: {centre.format('l')}) AS vs FROM {name}_b b JOIN {name}_l l ON b.g = l.g),
{name}_g AS (SELECT g, n - lag - 1 AS nobs, lag, {matrix} AS mat FROM {name}_f),
{name}_h AS (SELECT g, nobs, lag, 0 AS s, mat FROM {name}_g UNION ALL SELECT g, nobs, lag, s + 1, {step} FROM {name}_h WHERE s < lag),
{name}_t AS (SELECT g, mat[lag + 1][lag + 2] / sqrt(mat[lag + 1][lag + 1] * (mat[lag + 2][lag + 2] - pow(mat[lag + 1][lag + 2], 2) / mat[lag + 1][lag + 1]) / (nobs - (lag + 1 + {fixed}))) AS tau
  FROM {name}_h WHERE s = lag),
{name}_v AS (SELECT g, tau, CASE WHEN tau <= {k['star']}e0 THEN {poly(k['small'])} ELSE {poly(k['large'])} END AS v FROM {name}_t),
{name} AS (SELECT g, tau, CASE WHEN tau > {k['high']}e0 THEN 1e0 WHEN tau < {k['low']}e0 THEN 0e0 ELSE {cdf_sql('v')} END AS p FROM {name}_v)"""


def fixed_lag_sql(series: str, name: str, lag: int) -> str:
    """CTE ``name(g, tau)``: the statistic with a given number of differences, the regressions by their textbook formulas (lag 0 or 1)."""
    base = f""",
{name}_d AS (SELECT g, k, e - lag(e) OVER w AS y, lag(e) OVER w AS x, lag(e) OVER w - lag(e, 2) OVER w AS z FROM {series} WINDOW w AS (PARTITION BY g ORDER BY k))"""
    if lag == 0:
        return base + f""",
{name} AS (SELECT g, sum(x * y) / sqrt(sum(x * x) * (sum(y * y) - pow(sum(x * y), 2) / sum(x * x)) / (count(*) - 1)) AS tau FROM {name}_d WHERE k >= 1 GROUP BY g)"""
    return base + f""",
{name}_s AS (SELECT g, count(*) AS n, sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy FROM {name}_d WHERE k >= 2 GROUP BY g),
{name}_r AS (SELECT g, n, xx - xz * xz / zz AS a, xy - xz * zy / zz AS b, yy - zy * zy / zz AS c FROM {name}_s),
{name} AS (SELECT g, b / sqrt(a * (c - b * b / a) / (n - 2)) AS tau FROM {name}_r)"""


#: Two-sided p of a correlation r with n rows, from the finite series of Student's distribution.
PEARSON_SQL = """CASE WHEN n % 2 = 0
  THEN 1 - abs(r) * list_sum(list_transform(range(0, n // 2 - 1), lambda i: exp(lgamma(i + 0.5e0) - lgamma(i + 1e0)) / sqrt(pi()) * pow(1 - r * r, i)))
  ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * list_sum(list_transform(range(0, (n - 3) // 2), lambda i: sqrt(pi()) / 2 * exp(lgamma(i + 1e0) - lgamma(i + 1.5e0)) * pow(1 - r * r, i + 0.5e0)))) END"""
