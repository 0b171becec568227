"""Helpers for the session an operator runs in."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder, with its lineage cut.

    The folder is `spark.checkpoint.dir` of the session; only where that is
    unset (tests, a local shell) a temporary folder of this machine is taken.
    Replicated or shared storage keeps the data when an executor is lost.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="docketry-checkpoint-"))
    return df.checkpoint(eager=True)


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a written table, the bytes as its text and array columns hold them and 16 for any other value."""
    wide = [F.coalesce(F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(f.name)), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    each = sum((w.cast("long") for w in wide), F.lit(16 * len(df.columns)).cast("long"))
    rows, size = df.agg(F.count("*"), F.sum(each)).first()
    return rows, size or 0


def hot_keys(big: DataFrame, on: list[str], share: float) -> DataFrame:
    """The keys that hold over `share` of the rows of `big`: fewer than 1 / share, whatever the data."""
    total = big.count()
    counted = big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > max(1.0, total * share))
    return counted.select(*on, F.lit(True).alias("_hot"))


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", spread: str | None = None, limit: int = 200_000, limit_bytes: int = 64 << 20, salts: int = 32, share: float = 0.001) -> DataFrame:
    """Join with a side that is small as a rule; `small` should come from `cut`, as it is measured first.

    Up to `limit` rows and `limit_bytes` bytes it is broadcast: the size is then
    known, not guessed. Beyond, both sides are shuffled by key. Only keys that
    hold over `share` of the rows of `big` are counted as hot: their rows are
    salted by a hash of `spread` (a column that differs within a hot key) and
    their rows of `small` repeated `salts` times, so that one hot key becomes
    `salts` partitions; all other keys go once. `how` may be inner, left,
    left_semi or left_anti. A null key meets nothing.
    """
    rows, size = measure(small)
    if rows <= limit and size <= limit_bytes:
        return big.join(F.broadcast(small), on, how)
    hot = cut(hot_keys(big, on, share))  # under 1 / share rows
    by = F.xxhash64(F.col(spread)) if spread else F.xxhash64(*[F.col(c) for c in big.columns])
    salted = big.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(by, F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    return salted.join(repeated(small, hot, on, salts), [*on, "_salt"], how).drop("_salt")


def repeated(small: DataFrame, hot: DataFrame, on: list[str], salts: int) -> DataFrame:
    """`small` with a salt: rows of hot keys once for each salt, all others once."""
    marked = small.join(F.broadcast(hot), on, "left")
    return marked.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
