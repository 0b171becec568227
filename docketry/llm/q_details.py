"""Queries of problem 6 (personal details)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.pii_bootstrap import Details
from docketry.runtime import table


def _details(spark: SparkSession, d: str) -> Details:
    logs = table(spark, d, "chat_logs").select("id", "question", "answer")
    return Details(logs, "id", {"question": F.col("question"), "answer": F.col("answer")}, table(spark, d, "office_contacts"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _details(spark, d).found.select("id", "field_name", "kind", "start_pos")


def p6_masked(spark: SparkSession, d: str) -> DataFrame:
    return _details(spark, d).masked()


def p6_arms(spark: SparkSession, d: str) -> DataFrame:
    """Details by kind and by what found them."""
    return _details(spark, d).arms()


QUERIES = {"p6_arms": p6_arms, "p6_found": p6_found, "p6_masked": p6_masked}
ORACLE: dict[str, str] = {}
