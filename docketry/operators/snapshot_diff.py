"""What changed between consecutive full snapshots of a table.

Each snapshot is put in key order, cut into chunks at keys whose hash says so
(content-defined, so an inserted row moves no later boundary), and every chunk
gets a digest. Chunks equal in neighbouring snapshots are dropped whole; only
the rows of the others are put side by side and classified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 64
#: Rows of all snapshots that one bucket of keys should hold: a task sorts them.
BUCKET_ROWS = 500_000


def normal_hash(value: Column) -> Column:
    """A content hash without case, outer white space and algorithm name."""
    plain = F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(plain, r"(?U)^[a-z][a-z0-9_\-]*:\s*", "")


def normal_word(value: Column) -> Column:
    """A value without case and outer white space."""
    return F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def canonical_rows(snapshots: DataFrame, value: Column, buckets: int) -> DataFrame:
    """One row (snapshot_no, bucket, id, a, b) for each id of a snapshot, a and b being the digest of its value (128 bits).

    Of several rows for an id the one loaded last counts; of equally late ones
    the greatest value (null is the least). Rows without id or snapshot number
    belong to no record and are left out. Repeated rows of one id are combined
    before the shuffle, so that no id is hot.
    """
    rows = snapshots.select("snapshot_no", F.lower("id").alias("id"), "loaded_at", value.alias("value")).where("id IS NOT NULL AND snapshot_no IS NOT NULL")
    last = rows.groupBy("snapshot_no", "id").agg(F.max(F.struct("loaded_at", "value")).alias("last")).select("snapshot_no", "id", F.col("last.value").alias("value"))
    null, text = F.col("value").isNull(), F.coalesce("value", F.lit(""))
    return last.select("snapshot_no", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "id", F.xxhash64(null, text).alias("a"), F.xxhash64(text, F.lit("|"), null).alias("b"))


def snapshot_changes(snapshots: DataFrame, value: Column, chunk_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """Rows (snapshot_no, id, change_kind) for each delivered snapshot but the first.

    `snapshots` has snapshot_no, loaded_at, id and what `value` reads; other
    columns do not matter. Neighbours are delivered numbers, gaps are passed
    over. An empty table, or one with a single snapshot, gives no rows.

    All snapshots of a bucket of keys come together in one shuffle; sorting,
    chunking, the comparison of digests and that of rows follow in the same
    task. A chunk begins at a key whose hash is 0 modulo `chunk_rows` and is
    named by it (the first of a bucket by the empty text). Chunks whose digests
    are equal in both snapshots are dropped before their rows are compared.
    The number of buckets follows from the number of rows, if not given.
    """
    spark = snapshots.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:
        buckets = max(4 * width, snapshots.count() // BUCKET_ROWS)
    rows = canonical_rows(snapshots, value, buckets)
    rows = rows.repartition("bucket") if buckets <= 4 * width else rows.repartition(buckets, "bucket")
    order = Window.partitionBy("bucket", "snapshot_no").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.pmod(F.xxhash64(F.lit("cut"), "id"), F.lit(chunk_rows)) == 0, F.col("id"))
    rows = rows.withColumn("start", F.coalesce(F.max(opens).over(order), F.lit("")))
    numbers = snapshots.select("snapshot_no").where("snapshot_no IS NOT NULL").distinct()  # one row a snapshot
    by_number = Window.orderBy("snapshot_no")
    follows = numbers.select("snapshot_no", F.lag("snapshot_no").over(by_number).alias("last_no"), F.lead("snapshot_no").over(by_number).alias("next_no"))
    # a row is new in its own snapshot and old in the next one
    roles = F.array(F.struct(F.lit(True).alias("new"), F.when(F.col("last_no").isNotNull(), F.col("snapshot_no")).alias("no")), F.struct(F.lit(False).alias("new"), F.col("next_no").alias("no")))
    rows = rows.join(F.broadcast(follows), "snapshot_no").select("bucket", "start", "id", "a", "b", F.explode(roles).alias("x")).select("bucket", "start", "id", "a", "b", "x.*").where("no IS NOT NULL")
    digest = lambda new: F.struct(F.count_if(F.col("new") == new), F.bit_xor(F.when(F.col("new") == new, F.xxhash64("id", "a", "b"))), F.bit_xor(F.when(F.col("new") == new, F.xxhash64("b", F.lit("|"), "id", "a"))))
    chunks = rows.groupBy("bucket", "no", "start").agg(digest(True).alias("new_sum"), digest(False).alias("old_sum"), F.collect_list(F.struct("new", "id", "a", "b")).alias("rows"))
    unmatched = chunks.where(~F.col("new_sum").eqNullSafe(F.col("old_sum"))).select("bucket", "no", F.explode("rows").alias("x")).select("bucket", "no", "x.*")
    both = unmatched.groupBy("bucket", "no", "id").agg(F.count("*").alias("n"), F.bool_or("new").alias("new"), (F.min(F.struct("a", "b")) != F.max(F.struct("a", "b"))).alias("differs"))
    kind = F.when(F.col("n") == 2, F.when(F.col("differs"), "changed")).when(F.col("new"), "added").otherwise("removed")
    return both.select(F.col("no").alias("snapshot_no"), "id", kind.alias("change_kind")).where("change_kind IS NOT NULL")
