"""All queries of the engine, and its flagship."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from tessera import registry

for _name in ("text_queries", "retrieval_queries", "table_queries", "rollup_queries", "geo_queries", "geocode_queries", "intent_queries", "stream_queries", "mention_queries", "output_queries", "more_queries", "person_queries", "cleaning_queries"):
    importlib.import_module(f"tessera.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage, the best document windows, with their text."""
    return registry.QUERIES["rk14_search"](spark, sf_dir)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
