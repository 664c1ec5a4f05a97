"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.base import REGISTRY

for _name in ("cleaning", "duplicates", "sampling", "samples", "evaluation", "retrieval", "streams", "tasks"):
    import_module(f"millrace.plans.{_name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY["url_verdict"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
