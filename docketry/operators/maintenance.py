"""Immutable maintenance of keyed tables: every change is a function of (old table, changes).

Tables on plain Parquet are never updated in place: the result is written to a
new folder and the pointer to it is swapped.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows delivered more than once, unchanged, given once."""
    return df.dropDuplicates(list(keys))


def upsert(old: DataFrame, new: DataFrame, key: str, overwrite: list[str] | None = None, stamp: tuple[str, Column] | None = None) -> DataFrame:
    """`old` with `new` merged in by `key`.

    A key in both keeps the old row but for the columns in `overwrite` (all the
    new ones by default); a key only in `new` is inserted whole. Columns that
    `new` lacks stay as they are, or null. `stamp` sets a column of touched rows.
    """
    overwrite = [c for c in new.columns if c != key] if overwrite is None else overwrite
    n = new.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key])
    o = old.withColumn("_old", F.lit(True))
    both = o.join(n, key, "full")
    touched = F.col("_new").isNotNull()
    out = [F.col(key)]
    for c in old.columns:
        if c == key:
            continue
        value = F.col(c)
        if f"_n_{c}" in both.columns:
            new_wins = touched & (F.lit(c in overwrite) | F.col("_old").isNull())
            value = F.when(new_wins, F.col(f"_n_{c}")).otherwise(F.col(c))
        if stamp and stamp[0] == c:
            value = F.when(touched, stamp[1]).otherwise(value)
        out.append(value.alias(c))
    return both.select(*out)


def patch(old: DataFrame, keys: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """`old` with `values` set in the rows whose key is in `keys`."""
    marked = old.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])


def next_versions(versions: DataFrame, requests: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, version) for each requested key: one more than its latest version, 1 for a new key."""
    latest = versions.groupBy(key).agg(F.max("version").alias("latest"))
    return requests.select(key).distinct().join(latest, key, "left").select(key, (F.coalesce("latest", F.lit(0)) + 1).alias("version"))


def latest_per(df: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order (Catalyst turns this into a WindowGroupLimit)."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def retain(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Rows of the last `days` days before `as_of`."""
    return df.where(F.col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def version_diff(chunks: DataFrame, key: str = "source_id") -> DataFrame:
    """What the latest version of each key holds against the one before, by content hash.

    (key, new_version, old_version, added, removed, unchanged): added and removed
    count rows, unchanged distinct hashes. Keys with one version are left out.
    """
    numbers = chunks.select(key, "version").distinct()
    pairs = numbers.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))).where("rn <= 2").groupBy(key).agg(F.max("version").alias("new_version"), F.min("version").alias("old_version")).where("new_version > old_version")
    hashes = chunks.join(pairs, key).where("version IN (new_version, old_version)").groupBy(key, "new_version", "old_version", "content_hash").agg(
        F.count_if(F.col("version") == F.col("new_version")).alias("n_new"), F.count_if(F.col("version") == F.col("old_version")).alias("n_old")
    )
    return hashes.groupBy(key, "new_version", "old_version").agg(
        F.sum(F.when(F.col("n_old") == 0, F.col("n_new")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("n_new") == 0, F.col("n_old")).otherwise(0)).alias("removed"),
        F.count_if((F.col("n_new") > 0) & (F.col("n_old") > 0)).alias("unchanged"),
    )


def _latest_two(chunks: DataFrame, key: str) -> DataFrame:
    """The chunks of the two latest versions of each key that has two, marked with `new`."""
    numbers = chunks.select(key, "version").distinct()
    pairs = numbers.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("version")))).where("rn <= 2").groupBy(key).agg(F.max("version").alias("latest_version"), F.min("version").alias("previous_version")).where("latest_version > previous_version")
    return chunks.join(pairs, key).where("version IN (latest_version, previous_version)").withColumn("new", F.col("version") == F.col("latest_version"))


def index_diff(chunks: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, previous_version, latest_version, added, removed): the sorted chunk indices whose content hash only one of the two latest versions holds."""
    two = _latest_two(chunks, key)
    sides = two.groupBy(key, "previous_version", "latest_version", "content_hash").agg(F.bool_or("new").alias("in_new"), F.bool_or(~F.col("new")).alias("in_old"), F.sort_array(F.collect_list("chunk_index")).alias("at"))
    indices = lambda side, other: F.sort_array(F.flatten(F.collect_list(F.when(F.col(side) & ~F.col(other), F.col("at")))))
    return sides.groupBy(key, "previous_version", "latest_version").agg(indices("in_new", "in_old").alias("added"), indices("in_old", "in_new").alias("removed"))


def text_diff(chunks: DataFrame, key: str = "source_id") -> DataFrame:
    """(key, previous_version, latest_version, unified_diff) of the texts of the two latest versions, chunks in the order of their index.

    One row holds the two texts of one document, which a line diff has to see whole.
    """
    text = lambda new: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("new") == new, F.struct("chunk_index", "chunk_text")))), lambda x: x["chunk_text"]), "\n\n")
    rows = _latest_two(chunks, key).groupBy(key, "previous_version", "latest_version").agg(text(False).alias("old"), text(True).alias("new"))
    kind = dict(chunks.dtypes)

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for before, after, old, new in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                out.append("\n".join(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), f"v{before}", f"v{after}", lineterm="")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=[key, "previous_version", "latest_version", "unified_diff"])

    return rows.mapInArrow(diff, f"{key} {kind[key]}, previous_version {kind['version']}, latest_version {kind['version']}, unified_diff string")


def move_keys(table: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """`column` of `table` renamed by (old_value, new_value) pairs.

    A move whose old value is missing or whose new value is taken is left out.
    Batches with chains (a new value that another move frees) are refused, as
    their result would depend on the order of the pairs.
    """
    chained = moves.select(F.col("old_value").alias("v")).join(moves.select(F.col("new_value").alias("v")), "v", "left_semi")
    assert chained.isEmpty(), "chained moves: split the batch"
    taken = table.select(F.col(column).alias("new_value")).distinct()
    good = moves.join(taken, "new_value", "left_anti").select(F.col("old_value").alias(column), "new_value")
    return table.join(good, column, "left").withColumn(column, F.coalesce("new_value", column)).select(*table.columns)
