"""Queries of problems 8 (token ids) and 9 (filling containers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import encode_table
from docketry.llm.packing import CAPACITY, pack
from docketry.runtime import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_table(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    filled = p9_containers(spark, d).where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return filled.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("tokens").alias("fullest"), (F.sum("tokens") / F.count("*") / CAPACITY).alias("fill"))


QUERIES = {"p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill}
ORACLE: dict[str, str] = {}
