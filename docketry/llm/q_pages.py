"""Queries of problems 4 (template residue) and 10 (keyword and link spam)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.keyword_spam import SpamPages, spam_pages
from docketry.llm.template_residue import TemplateResidue
from docketry.runtime import table


def _residue(spark: SparkSession, d: str) -> TemplateResidue:
    chunks = table(spark, d, "chunks").select("id", "chunk_text", "source_url", "source_id")
    titles = table(spark, d, "sources").select(F.col("id").alias("key"), "title")
    return TemplateResidue(chunks, "id", "chunk_text", "source_url", "source_id", titles)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).findings().select("id").distinct()


def p4_findings(spark: SparkSession, d: str) -> DataFrame:
    """Number of findings and of chunks with each verdict, and whether the evidence of hosts finds them too."""
    return _residue(spark, d).findings().groupBy("verdict", "hosted").agg(F.countDistinct("id").alias("chunks"), F.count("*").alias("segments"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents"), "doc_id", "text", "source").select(F.col("id").alias("doc_id"))


def p10_arms(spark: SparkSession, d: str) -> DataFrame:
    """Spam pages that are found as stitched from phrases of other hosts, as lists by themselves, or only by both together."""
    pages = SpamPages(table(spark, d, "documents"), "doc_id", "text", "source").pages.where("density > 0.5")
    return pages.groupBy((F.col("stitched_density") > 0.5).alias("stitched"), (F.col("own_density") > 0.5).alias("own")).agg(F.count("*").alias("documents"))


QUERIES = {"p10_arms": p10_arms, "p4_found": p4_found, "p4_findings": p4_findings, "p10_found": p10_found}
ORACLE: dict[str, str] = {}
