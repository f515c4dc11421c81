"""Stored tables that are changed: upserts by partition, and versions behind a manifest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import written


def _there(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in a folder, None while there is none."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def upsert(rows: DataFrame, folder: str, keys: list[str], partition: str, order: list[str] | None = None) -> int:
    """Last writer wins on ``keys`` in a table partitioned by ``partition`` (one of
    them): stored rows of a new row's key are replaced, of equal new keys the one
    largest in ``order`` (all other columns by default) stays. Only partitions that
    a row changes are read and written; the others keep their files. A run that
    changes nothing writes nothing. Returns the number of partitions written."""
    if partition not in keys:
        raise ValueError("the partition has to be part of the key, or a changed row could leave its old one behind")
    spark = rows.sparkSession
    rest = order or [c for c in rows.columns if c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*map(F.desc_nulls_last, rest or keys)))
    new = written(rows.withColumn("_n", place).where("_n = 1").drop("_n"))
    old = _there(spark, folder)
    if old is None:
        changed = new
    else:
        old = old.select(*(F.col(c).cast(new.schema[c].dataType) for c in new.columns))
        inside = lambda rows, some: rows.join(F.broadcast(some), partition, "left_semi").select(*new.columns)  # noqa: E731  one row a partition
        fresh = written(new.exceptAll(inside(old, new.select(partition).distinct())).select(partition).distinct())
        now, kept = inside(new, fresh), inside(old, fresh).join(new.select(*keys), keys, "left_anti").select(*new.columns)
        changed = written(now.unionByName(kept))  # read before its folder is written
    n = changed.select(partition).distinct().count()
    if n:
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)
    return n


def commit(rows: DataFrame, folder: str, note: str = "") -> int:
    """Write a version: its rows go to a folder of their own, then one row of the
    manifest names it. Without that row nobody sees it. Returns its number. Versions
    are numbered by one writer at a time; two at once would take the same number,
    and the one that commits first keeps it."""
    spark = rows.sparkSession
    number = (max((r.version for r in versions(spark, folder).select("version").collect()), default=0)) + 1  # one row a version
    name = uuid.uuid4().hex
    rows.write.parquet(f"{folder}/data/{name}")
    entry = spark.createDataFrame([(number, name, note)], "version long, name string, note string").withColumn("at", F.current_timestamp())
    entry.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest/number={number}")
    return number


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, name, note, at) of the committed versions."""
    schema = "version long, name string, note string, at timestamp"
    there = _there(spark, f"{folder}/manifest")
    return spark.createDataFrame([], schema) if there is None else there.select("version", "name", "note", "at")


def as_of(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The rows of a version, of the last one by default."""
    known = versions(spark, folder)
    row = (known.where(F.col("version") == version) if version else known).orderBy(F.desc("version")).first()
    if row is None:
        raise LookupError(f"no version {version or ''} in {folder}")
    return spark.read.parquet(f"{folder}/data/{row.name}")
