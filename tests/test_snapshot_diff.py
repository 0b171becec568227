from __future__ import annotations

import random

from pyspark.sql import functions as F

from docketry.operators.snapshot_diff import normal_hash, normal_word, snapshot_changes

SCHEMA = "snapshot_no int, loaded_at timestamp, id string, review_status string, snapshot_no_ string"


def rows(spark, data):
    return spark.createDataFrame([(n, None if t is None else f"2031-01-{t:02d}", i, v, "x") for n, t, i, v in data], "snapshot_no int, loaded_at string, id string, review_status string, other string").withColumn("loaded_at", F.to_timestamp("loaded_at"))


def changes(spark, data, **k):
    return {(r.snapshot_no, r.id, r.change_kind) for r in snapshot_changes(rows(spark, data), normal_word(F.col("review_status")), **k).collect()}


def test_kinds_gaps_late_rows_and_nulls(spark):
    data = [
        (1, 1, "A", "x"), (1, 1, "b", "x"), (1, 1, "c", None), (1, 1, None, "x"), (None, 1, "z", "x"),
        (3, 2, "a", " X\t"), (3, 2, "c", "y"), (3, 2, "d", "x"), (3, 3, "d", "y"), (3, 3, "D", "y"),
        (4, 4, "a", "x"), (4, 4, "c", None), (4, 5, "d", "y"),
    ]
    assert changes(spark, data) == {(3, "b", "removed"), (3, "c", "changed"), (3, "d", "added"), (4, "c", "changed")}


def test_empty_and_single(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(1, 1, "a", "x")]) == set()


def test_against_brute_force(spark):
    random.seed(3)
    data, truth = [], set()
    before = None
    for n in (1, 2, 5, 6):
        now = {f"k{random.randrange(900)}": random.choice("abc") for _ in range(500)} if before is None else {k: (random.choice("abc") if random.random() < 0.05 else v) for k, v in before.items() if random.random() > 0.05}
        if before is not None:
            for i in range(20):
                now[f"new{n}-{i}"] = "a"
            truth |= {(n, k, "added") for k in now.keys() - before.keys()} | {(n, k, "removed") for k in before.keys() - now.keys()} | {(n, k, "changed") for k in now.keys() & before.keys() if now[k] != before[k]}
        data += [(n, 1, k.upper() if random.random() < 0.3 else k, v) for k, v in now.items()]
        before = now
    for chunk_rows in (1, 8, 64):
        assert changes(spark, data, chunk_rows=chunk_rows, buckets=4) == truth


def test_normal_hash(spark):
    df = spark.createDataFrame([("SHA256:AB ",), (" ab\t",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(normal_hash(F.col("h"))).collect()] == ["ab", "ab", None, ""]
