"""Run registered queries in Spark and their SQL in DuckDB and compare.

    python tests/compare.py [--sf 0.01] [--exact] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def make_spark():
    import tempfile
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("tandem-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    import datetime
    import numpy as np
    import pandas as pd
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime, datetime.date)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    data = [tuple(_cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(data, key=repr)


def kinds(pdf):
    return {c: pdf[c].dtype.kind for c in pdf.columns}


def same(a, b, tol):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, (float, int)):
        return (a == b and math.copysign(1, a) == math.copysign(1, b)) or (tol and math.isclose(a, b, rel_tol=tol, abs_tol=tol))
    return a == b


def check(spark, con, name, fn, sql, sf_dir, tol=0.0):
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return (len(got) > 0), f"rows={len(got)} (no sql) spark={t1 - t0:.1f}s"
    want = con.execute(sql).df()
    t2 = time.time()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    note = f"rows={len(gr)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s"
    if gc != wc:
        return False, f"{note} columns {gc} vs {wc}"
    if len(gr) != len(wr):
        return False, f"{note} row count {len(gr)} vs {len(wr)}"
    gk, wk = kinds(got), kinds(want)
    diff_k = {c: (gk[c], wk[c]) for c in gc if gk[c] != wk[c]}
    bad = [(a, b) for a, b in zip(gr, wr) if not all(same(x, y, tol) for x, y in zip(a, b))]
    if bad:
        return False, f"{note} {len(bad)} rows differ e.g.\n   {bad[0][0]}\n   {bad[0][1]}\n   cols {gc}"
    return bool(len(gr)) and not diff_k, f"{note} {'kinds ' + str(diff_k) if diff_k else ''}"


def main(argv):
    sf = "0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_spark(), make_duck(sf_dir)
    failed = []
    for n in names:
        try:
            ok, note = check(spark, con, n, queries[n], oracles.get(n), sf_dir)
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(("ok   " if ok else "FAIL ") + n, note, flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
