"""Reports on a conversation log, rate limits and suppression of repeats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """(n, median, most) with the upper median sorted[n div 2] of a whole-number column, nulls left out.

    Exact: equal values are counted first, then a running count over the distinct
    values finds the place. One task orders these counts, so the column should
    have a bounded number of values, as whole milliseconds or tokens have.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    running = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v")))
    return running.agg(F.max("n").alias("n"), at.alias("median"), F.max("v").alias("most"))


def over_limit(events: DataFrame, key: str, ts: str, per: str, limit: int) -> DataFrame:
    """events with `rejected`: the requests of a key beyond the first `limit` of a fixed window."""
    w = Window.partitionBy(key, F.window(ts, per)).orderBy(ts, *[c for c in events.columns if c not in (key, ts)][:1])
    return events.withColumn("rejected", F.row_number().over(w) > limit)


def suppress_repeats(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """events with `kept`: not within `seconds` of the last kept event of its key.

    The span counts from the event kept, repeats do not extend it: a fold in time
    order (equal times in the order of the first other column). Events are sorted
    by key and time within their partition and pass in Arrow batches with the
    last kept time carried along, so a busy key needs no memory of its own.
    """
    others = [c for c in events.columns if c not in (key, ts)][:1]
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = events.withColumn("_t", t).withColumn("_key", F.xxhash64(key))
    ordered = marked.repartition(key).sortWithinPartitions(F.col(key).asc_nulls_first(), "_t", *others)
    span, names = seconds * 1_000_000, [*events.columns, "kept"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None  # the hash of the key at hand and the time of its last kept event
        for batch in batches:
            kept = []
            for k, at in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) - 1).to_pylist()):
                if k != now:
                    now, last = k, None
                keep = at is not None and (last is None or at - last > span)
                if keep:
                    last = at
                kept.append(keep)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(kept, pa.bool_())], names=names)

    return ordered.mapInArrow(fold, StructType([*events.schema.fields, StructField("kept", BooleanType())]))


def recent_turns(turns: DataFrame, most: int = 10, budget: int = 2400) -> DataFrame:
    """The end of each conversation (conv, turn, role, content) that fits a prompt.

    Of user and assistant turns with content the last `most`, the oldest dropped
    until all lengths fit `budget`; leading turns of others than the user go,
    and neighbouring turns of one role become one.
    """
    down = Window.partitionBy("conv").orderBy(F.desc("turn"))
    kept = turns.where("role IN ('user', 'assistant') AND content <> ''").withColumn("back", F.row_number().over(down)).where(F.col("back") <= most)
    kept = kept.withColumn("used", F.sum(F.length("content")).over(down)).where(F.col("used") <= budget)
    up = Window.partitionBy("conv").orderBy("turn")
    kept = kept.withColumn("asked", F.max(F.when(F.col("role") == "user", 1)).over(up)).where("asked = 1")
    marked = kept.withColumn("new", F.when(F.col("role").eqNullSafe(F.lag("role").over(up)), 0).otherwise(1)).withColumn("run", F.sum("new").over(up))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n")
    return marked.groupBy("conv", "run").agg(F.min("role").alias("role"), joined.alias("content"))


def turn_format(turns: DataFrame) -> DataFrame:
    """(conv, run, role, parts) of turns (conv, turn, role, content) as a service with alternating turns takes them.

    System texts come first as run 0, joined by blank lines; an assistant is a
    `model`, everyone else a `user`; neighbouring turns of one role are parts of one.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"])
    system = turns.where("role = 'system'").groupBy("conv").agg(F.array(F.array_join(parts, "\n\n")).alias("parts"))
    up = Window.partitionBy("conv").orderBy("turn")
    rest = turns.where("role IS NULL OR role <> 'system'").withColumn("role", F.when(F.col("role") == "assistant", "model").otherwise("user"))
    rest = rest.withColumn("new", F.when(F.col("role") == F.lag("role").over(up), 0).otherwise(1)).withColumn("run", F.sum("new").over(up))
    said = rest.groupBy("conv", "run").agg(F.first("role").alias("role"), parts.alias("parts"))
    return system.select("conv", F.lit(0).cast("long").alias("run"), F.lit("system").alias("role"), "parts").unionByName(said)


def most_asked(logs: DataFrame, norm: Column, top: int) -> DataFrame:
    """(norm, n, wording) of the questions asked most often; the wording is the first seen, ties in the order of first sight (A10)."""
    rows = logs.withColumn("norm", norm).where("norm IS NOT NULL")
    seen = rows.groupBy("norm").agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id", "question")).alias("first"))
    return seen.orderBy(F.desc("n"), "first.created_at", "first.id").limit(top).select("norm", "n", F.trim("first.question").alias("wording"))
