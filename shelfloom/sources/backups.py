"""Dated copies of a table in one folder, one partition a day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, folder: str, day: date) -> None:
    """The copy of a day; a second one of the same day replaces it."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/day={day:%Y-%m-%d}")


def kept(spark: SparkSession, folder: str, today: date, days: int = 30) -> DataFrame:
    """All copies not older than ``days``; the older ones' files are never opened
    (partition pruning). Whoever owns the folder deletes those."""
    return spark.read.parquet(folder).where(F.col("day").cast("date") >= F.lit(today - timedelta(days=days)))


def restore(spark: SparkSession, folder: str, today: date, days: int = 30) -> DataFrame:
    """The newest copy among those kept and not after ``today``."""
    rows = kept(spark, folder, today, days).where(F.col("day").cast("date") <= F.lit(today))
    last = rows.agg(F.max("day")).first()[0]  # one value
    return rows.where(F.lit(False) if last is None else F.col("day") == F.lit(last)).drop("day")
