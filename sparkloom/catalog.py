"""All queries of the library in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom import registry
from sparkloom.plans import index_queries, knowledge_queries, lifecycle_queries, note_queries, page_queries, search_queries, store_queries, text_queries  # noqa: F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["bm25_topk"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracles() -> dict[str, str]:
    return registry.ORACLES
