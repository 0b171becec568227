from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry.runtime import cut, hot_keys, join_small, measure, repeated


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_shuffled_join_equals_broadcast_join(spark, how):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(0, 100, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    ways = [{}, {"limit": 0}, {"limit": 0, "spread": "id"}, {"limit_bytes": 10, "spread": "id", "share": 0.1}]
    rows = [sorted(map(tuple, join_small(big, small, ["k"], how=how, **w).collect()), key=str) for w in ways]
    assert rows[0] == rows[1] == rows[2] == rows[3] and rows[0]


def test_only_hot_keys_are_repeated(spark):
    big = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)], "k string, n int")
    small = spark.createDataFrame([("hot", 1), *((f"k{i}", 1) for i in range(100))], "k string, v int")
    hot = hot_keys(big, ["k"], 0.01)
    assert [r.k for r in hot.collect()] == ["hot"]
    assert {r.k: r["count"] for r in repeated(small, hot, ["k"], 8).groupBy("k").count().collect()} == {"hot": 8, **{f"k{i}": 1 for i in range(100)}}
    assert hot_keys(big.limit(0), ["k"], 0.01).count() == 0


def test_long_values_count_as_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2], None), (None, None, 1)], "a string, b array<int>, c int")
    assert measure(df) == (2, 1000 + len("[1,2]") + 2 * 3 * 16)
    assert measure(df.limit(0)) == (0, 0)


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, "x", None)], "a long, b string, c array<string>")
    assert sorted(map(tuple, cut(df).collect()), key=str) == sorted(map(tuple, df.collect()), key=str) and cut(df).schema == df.schema
    assert cut(df.limit(0)).count() == 0
