"""All core queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.plans import citing, corpus, ingest, reports, search, snapshots, texts

MODULES = (snapshots, corpus, search, reports, texts, citing, ingest)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search.r02_boosted_search(spark, folder)
