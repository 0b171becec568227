"""Queries on table snapshots (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.snapshot_diff import normal_hash, normal_word, snapshot_changes
from docketry.runtime import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    versions = snapshot_changes(table(spark, d, "source_version_snapshots"), normal_hash(F.col("content_hash")))
    chunks = snapshot_changes(table(spark, d, "chunk_snapshots"), normal_word(F.col("review_status")))
    both = versions.withColumn("record_kind", F.lit("source_version")).unionByName(chunks.withColumn("record_kind", F.lit("chunk")))
    return both.select("record_kind", "snapshot_no", "id", "change_kind")


QUERIES = {"p5_found": p5_found}

_SIDE = """
SELECT '{kind}' AS record_kind, snapshot_no, lower(id) AS id, {value} AS v, loaded_at FROM {table}
WHERE id IS NOT NULL AND snapshot_no IS NOT NULL"""

ORACLE = {
    "p5_found": "WITH raw AS ("
    + _SIDE.format(kind="source_version", table="source_version_snapshots", value=r"regexp_replace(lower(regexp_replace(content_hash, '^\s+|\s+$', '', 'g')), '^[a-z][a-z0-9_\-]*:\s*', '')")
    + " UNION ALL "
    + _SIDE.format(kind="chunk", table="chunk_snapshots", value=r"lower(regexp_replace(review_status, '^\s+|\s+$', '', 'g'))")
    + """), one AS (SELECT record_kind, snapshot_no, id, v FROM raw
    QUALIFY row_number() OVER (PARTITION BY record_kind, snapshot_no, id ORDER BY loaded_at DESC NULLS LAST, v DESC NULLS LAST) = 1),
  nos AS (SELECT record_kind, snapshot_no, lead(snapshot_no) OVER (PARTITION BY record_kind ORDER BY snapshot_no) AS next_no
    FROM (SELECT DISTINCT record_kind, snapshot_no FROM one)),
  old AS (SELECT o.record_kind, n.next_no AS snapshot_no, id, v FROM one o JOIN nos n USING (record_kind, snapshot_no) WHERE n.next_no IS NOT NULL),
  new AS (SELECT o.* FROM one o SEMI JOIN nos n ON o.record_kind = n.record_kind AND o.snapshot_no = n.next_no)
SELECT coalesce(n.record_kind, o.record_kind) AS record_kind, coalesce(n.snapshot_no, o.snapshot_no) AS snapshot_no, coalesce(n.id, o.id) AS id,
  CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM new n FULL JOIN old o ON n.record_kind = o.record_kind AND n.snapshot_no = o.snapshot_no AND n.id = o.id
WHERE o.id IS NULL OR n.id IS NULL OR n.v IS DISTINCT FROM o.v""",
}
