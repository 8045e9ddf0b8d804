"""Every registered query against its SQL (rows only where there is none)."""

import pytest

import __spark_entry__ as entry
from compare import check

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# On the smallest tables nothing meets these conditions; they still must run and agree.
MAY_BE_EMPTY = {"p03_drop_null_rows", "p04_drop_incomplete_symbols", "j03_enumerate_pairs_in_group", "k03_trades_v1",
                "s01_read_bars_wide_whole_rows", "r04_stream_signals", "p16_filter_models_v0", "a21_coint_pairs"}


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 180


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    ok, note = check(spark, duck, name, QUERIES[name], SQL.get(name), sf_dir)
    assert ok or (name in MAY_BE_EMPTY and note.startswith("rows=0")), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
