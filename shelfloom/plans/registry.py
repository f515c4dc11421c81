"""All registered queries of the analytics part, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfloom.operators import shelf as S
from shelfloom.sources import views as V

from . import analytics, checks, dashboard, insight, knowledge, reports, search, stored, texts

MODULES = [analytics, insight, reports, dashboard, texts, knowledge, checks, search, stored]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading brand, its share and the concentration of every month and category."""
    return S.market_metrics(V.shelf(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for m in MODULES for name, plan in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
