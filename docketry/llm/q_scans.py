"""Queries of problem 3 (noise in text from scanned pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm.ocr_repair import ScanRepair
from docketry.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return ScanRepair(table(spark, d, "extracted_chunks")).found


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return ScanRepair(table(spark, d, "extracted_chunks")).paragraphs()


QUERIES = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs}
ORACLE: dict[str, str] = {}
