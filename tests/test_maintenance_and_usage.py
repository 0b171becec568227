from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketry.operators import maintenance as M
from docketry.operators import usage as U
from docketry.operators.retrieval import boosted, dense_top_k, fuse_lists


def test_upsert_is_idempotent_and_keeps_other_columns(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, v int, s string")
    new = spark.createDataFrame([("b", 9, "n"), ("c", 3, None)], "id string, v int, s string")
    once = M.upsert(old, new, "id", overwrite=["s"])
    want = {("a", 1, "x"), ("b", 2, "n"), ("c", 3, None)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in M.upsert(once, new, "id", overwrite=["s"]).collect()} == want
    assert {tuple(r) for r in M.upsert(old, new.limit(0), "id").collect()} == {tuple(r) for r in old.collect()}


def test_moves(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    moves = spark.createDataFrame([("a", "x"), ("b", "c"), ("gone", "y")], "old_value string, new_value string")
    assert {r.url for r in M.move_keys(t, moves, "url").collect()} == {"x", "b", "c"}
    with pytest.raises(AssertionError):
        M.move_keys(t, spark.createDataFrame([("a", "b"), ("b", "z")], "old_value string, new_value string"), "url")


def test_version_diff(spark):
    rows = [("s", 1, "h1"), ("s", 1, "h2"), ("s", 2, "h2"), ("s", 2, "h3"), ("s", 2, "h3"), ("t", 1, "h1")]
    got = M.version_diff(spark.createDataFrame(rows, "source_id string, version int, content_hash string")).collect()
    assert [tuple(r) for r in got] == [("s", 2, 1, 2, 1, 1)]


def test_upper_median(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "v int")
    assert tuple(U.upper_median(df, "v").first()) == (4, 3, 4)
    assert tuple(U.upper_median(df.limit(0), "v").first()) == (None, None, None)


def test_rate_limit_and_repeats(spark):
    rows = [(i, "k", f"2031-01-01 00:00:{i % 60:02d}") for i in range(60)] + [(100 + i, f"u{i}", "2031-01-01 00:00:30") for i in range(65)] + [(60, "k", "2031-01-01 00:00:59")]
    e = spark.createDataFrame(rows, "id int, key string, t string").select("id", "key", F.to_timestamp("t").alias("ts"))
    assert [r.id for r in U.over_limit(e, "key", "ts", "1 minute", 60).where("rejected").collect()] == [60]
    times = [(0, "a", 0), (1, "a", 100), (2, "a", 190), (3, "a", 300), (4, "a", 371), (5, "b", 5)]
    e = spark.createDataFrame(times, "id int, key string, s int").select("id", "key", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.id for r in U.suppress_repeats(e, "key", "ts", 180).where("kept").collect()) == [0, 2, 4, 5]


def test_recent_turns(spark):
    rows = [("c", 0, "assistant", "hello"), ("c", 1, "user", "q1"), ("c", 2, "user", "q2"), ("c", 3, "system", "s"), ("c", 4, "assistant", "a"), ("d", 0, "user", "x" * 3000), ("d", 1, "assistant", "y"), ("e", 0, "user", None)]
    got = U.recent_turns(spark.createDataFrame(rows, "conv string, turn int, role string, content string")).orderBy("conv", "run").collect()
    assert [(r.conv, r.role, r.content) for r in got] == [("c", "user", "q1\nq2"), ("c", "assistant", "a")]


def test_fusion(spark):
    lists = [("q", n + 1, p + 1, i, w) for n, (w, ids) in enumerate([(1.0, "abcd"), (1.5, "xbyz")]) for p, i in enumerate(ids)]
    df = spark.createDataFrame(lists, "qid string, list_no int, pos int, id string, weight double")
    assert [r.id for r in fuse_lists(df, 3).orderBy("rank").collect()] == ["b", "x", "y"]
    assert {r.id for r in fuse_lists(df, 3, keep_top=1).collect()} == {"a", "x", "b"}


def test_boost(spark):
    df = spark.createDataFrame([("q", "a", 0.50, 1, False), ("q", "b", 0.48, 2, True), ("q", "c", 0.46, 3, True), ("r", "a", 0.75, 1, False), ("r", "b", 0.67, 2, True)], "qid string, id string, score double, rank int, flag boolean")
    got = boosted(df, F.col("flag"), 0.05, 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [("q", "b", 0.48), ("q", "c", 0.46), ("r", "a", 0.75), ("r", "b", 0.67)]


def test_dense_top_k_in_blocks_ties_and_nulls(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(50, None), (51, [0.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    q = spark.createDataFrame([(1, [0.0, 2.0]), (2, [2.0, 1.0]), (3, None)], "qid long, vector array<double>")
    for block in (1, 8):
        got = dense_top_k(q, c, 3, block=block).orderBy("qid", "rank").collect()
        assert [(r.qid, r.id, r.score) for r in got] == [(1, 0, 1.0), (1, 3, 1.0), (1, 6, 1.0), (2, 2, 1.0), (2, 5, 1.0), (2, 8, 1.0)]
    assert dense_top_k(q.limit(0), c, 3).count() == 0 and dense_top_k(q, c.limit(0), 3).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    from docketry.plans import corpus, search

    latest = plan(corpus.k06_latest_version(spark, sf))
    assert "WindowGroupLimit" in latest
    assert "TakeOrderedAndProject" in plan(corpus.k05_pinned_chunks(spark, sf))
    sparse = plan(search.k02_sparse_top_k(spark, sf))
    assert "CartesianProduct" not in sparse and "BroadcastNestedLoopJoin" not in sparse
    assert "PushedFilters: [IsNotNull(source)" in sparse
