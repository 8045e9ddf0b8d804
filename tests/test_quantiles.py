"""Exact quantiles on ties, fat tails and small groups: one path for every size."""

import numpy as np
import pytest

from tandem.functions.quantiles import exact_quantiles


def test_quantiles(spark):
    rng = np.random.default_rng(4)
    groups = {"tails": rng.standard_cauchy(30_000), "ties": rng.integers(0, 3, 25_000).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]),
              "some": rng.normal(size=157), "same": np.full(3000, 7.0), "half": np.concatenate([np.zeros(20_000), rng.normal(size=20_000)])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("nothing", None)]
    qs = [0.0, 0.001, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {(r.k, r.q): r.quantile for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", qs).collect()}
    assert set(got) == {(k, q) for k in groups for q in qs}
    for (k, q), x in got.items():
        assert x == pytest.approx(np.quantile(groups[k], q), rel=1e-12, abs=1e-12)


def test_ranks_tie_as_in_sql(spark):
    """Values half way between two quantiles: the last bit of the interpolation decides, so it must be the SQL engine's."""
    import duckdb

    from tandem.operators.volatility import RANK_GRID, quantile_rank_series

    rng = np.random.default_rng(1)
    rows = [(g, k, round(float(x), 2)) for g in range(300) for k, x in enumerate(rng.integers(1, 60, rng.integers(4, 60)) * rng.choice([0.01, 0.05, 0.1]))]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (g INTEGER, k INTEGER, value DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?)", rows)
    qs = ", ".join(str(q) for q in RANK_GRID)
    want = con.execute(f"""WITH u AS (SELECT g, unnest([{qs}]) AS q, unnest(quantile_cont(value, [{qs}])) AS v FROM e GROUP BY g)
        SELECT g, k, CAST(arg_min(q, ROW(abs(v - value), q)) AS DOUBLE) FROM e JOIN u USING (g) GROUP BY 1, 2""").fetchall()
    got = quantile_rank_series(spark.createDataFrame(rows, "g int, k int, value double"), ["g"], "value").select("g", "k", "q").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
