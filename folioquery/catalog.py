"""The queries of the engine's own operators, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioquery.plans import oracles
from folioquery.plans import queries as plans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.rerank_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
