"""Queries of problem 2 (main content of pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.lines import site_of
from docketry.llm.style_tree import StyleTree
from docketry.runtime import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages (by path) and chunks (by id) with their sites."""
    sources = table(spark, d, "sources").select(F.col("id").alias("source_id"), site_of(F.col("url")).alias("site"))
    versions = table(spark, d, "source_versions").select("raw_content_path", "source_id").where("raw_content_path IS NOT NULL")
    paths = versions.groupBy("raw_content_path").agg(F.min("source_id").alias("source_id")).join(sources, "source_id", "left").select("raw_content_path", "site")
    raw = table(spark, d, "raw_pages").select("raw_content_path", F.col("page_text").alias("text")).join(paths, "raw_content_path", "left")
    chunks = table(spark, d, "chunks").select("id", F.col("chunk_text").alias("text"), site_of(F.col("source_url")).alias("site"))
    return raw.select(F.col("raw_content_path").alias("id"), "text", F.concat(F.lit("page:"), "site").alias("site")).unionByName(chunks.withColumn("site", F.concat(F.lit("chunk:"), "site")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return StyleTree(_pages(spark, d)).furniture.select(F.col("id").alias("record_id"), "line_no")


def p2_main(spark: SparkSession, d: str) -> DataFrame:
    """Each page and chunk without its furniture."""
    pages = _pages(spark, d)
    return StyleTree(pages).main_content(pages).withColumnRenamed("id", "record_id")


def p2_arms(spark: SparkSession, d: str) -> DataFrame:
    """Lines found by the tree (by nodes, presentations or boxes), by the lists, or by both."""
    arms = StyleTree(_pages(spark, d)).lines.where("prior OR tree IS NOT NULL")
    return arms.groupBy(F.coalesce("tree", F.lit("none")).alias("tree"), F.col("prior").alias("listed")).agg(F.count("*").alias("lines"))


QUERIES = {"p2_arms": p2_arms, "p2_found": p2_found, "p2_main": p2_main}
ORACLE: dict[str, str] = {}
