"""Queries of problem 1 (frequent items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.heavy_hitters import frequent_items, normal_item
from docketry.runtime import table

SHARE = 0.004


def _fields() -> dict:
    return {"question": normal_item(F.col("question")), "outcome": normal_item(F.col("outcome"))}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_items(table(spark, d, "chat_logs"), "id", _fields(), share=SHARE).select("field_name", "item")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent items of each field with their counts (a top-k report)."""
    return frequent_items(table(spark, d, "chat_logs"), "id", _fields(), top=100)


QUERIES = {"p1_found": p1_found, "p1_top": p1_top}

_NORMAL = r"regexp_replace(trim(regexp_replace(lower({0}), '[ \t\r\n]+', ' ', 'g')), '[?!. ]+$', '')"
_COUNTS = f"""WITH one AS (SELECT id, min({_NORMAL.format("question")}) AS question, min({_NORMAL.format("outcome")}) AS outcome FROM chat_logs WHERE id IS NOT NULL GROUP BY id),
  v AS (SELECT 'question' AS field_name, question AS item FROM one UNION ALL SELECT 'outcome', outcome FROM one),
  c AS (SELECT field_name, item, count(*) AS n, (SELECT count(*) FROM one) AS ids FROM v WHERE item IS NOT NULL GROUP BY ALL)"""
ORACLE = {
    "p1_found": f"{_COUNTS} SELECT field_name, item FROM c WHERE n >= {SHARE} * ids",
    "p1_top": f"{_COUNTS} SELECT field_name, item, n, ids FROM c QUALIFY row_number() OVER (PARTITION BY field_name ORDER BY n DESC, item) <= 100",
}
