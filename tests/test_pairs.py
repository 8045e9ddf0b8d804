"""Pairs of a universe, dealt by blocks."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tandem.operators.pairs import enumerate_pairs


@pytest.mark.parametrize("block", [1, 3, 512])
def test_every_pair_once_whatever_the_blocks(spark, block):
    rows = [(g, f"s{k:02d}") for g, n in (("big", 23), ("one", 1), ("two", 2)) for k in range(n)] * 2
    d = spark.createDataFrame(rows, "g string, symbol string")
    want = sorted((g, f"{a}_{b}", a, b) for g in ("big", "one", "two") for a, b in combinations(sorted({s for h, s in rows if h == g}), 2))
    assert sorted(map(tuple, enumerate_pairs(d, ["g"], block=block).collect())) == want
    assert sorted(map(tuple, enumerate_pairs(d, block=block).collect())) == sorted((f"{a}_{b}", a, b) for a, b in combinations([f"s{k:02d}" for k in range(23)], 2))


def test_the_tasks_of_a_large_group_are_even(spark):
    """One group: no task has more than a few blocks' worth of its pairs."""
    d = spark.range(3000).select(F.lit("g").alias("g"), F.format_string("s%05d", F.col("id").cast("int")).alias("symbol"))
    n = [r["count"] for r in enumerate_pairs(d, ["g"], block=100).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(n) == 3000 * 2999 // 2 and max(n) < sum(n) / 8
