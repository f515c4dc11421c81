"""Promotion summaries and alert classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_brand(deals: DataFrame, k: int = 20) -> DataFrame:
    per = deals.groupBy("brand").agg(F.count("*").alias("deals"), F.count_if(F.col("deal_type") == "lightning").alias("lightning"), F.avg("discount_percent").alias("avg_discount"), F.max("discount_percent").alias("max_discount"), F.count_distinct("asin").alias("products"))
    return per.orderBy(F.desc("deals"), "brand").limit(k)


def by_date(deals: DataFrame) -> DataFrame:
    return deals.groupBy(F.to_date("snapshot_datetime").alias("day")).agg(F.count("*").alias("deals"), F.count_distinct("brand").alias("brands"), F.avg("discount_percent").alias("avg_discount"))


def latest(deals: DataFrame, kind: str | None = None, k: int = 200) -> DataFrame:
    rows = deals if kind is None else deals.where(F.col("deal_type") == kind)
    return rows.groupBy("snapshot_datetime", "asin", "brand").agg(F.max("discount_percent").alias("discount_percent")).orderBy(F.desc("snapshot_datetime"), "asin").limit(k)


def alert_classes(deals: DataFrame, least: int = 5, deep: int = 30) -> DataFrame:
    """First matching class: lightning, deep discount, deal of the day, plain discount."""
    kind = F.when(F.col("deal_type") == "lightning", "lightning").when(F.col("discount_percent") >= deep, "deep").when(F.col("deal_type") == "deal_of_day", "day").when(F.col("discount_percent") >= least, "discount")
    return deals.withColumn("alert", kind).where("alert is not null").groupBy("brand", "alert").agg(F.count("*").alias("alerts"))


def competitor_deals(deals: DataFrame, own: str, part: str | None = None, hours: int = 24) -> DataFrame:
    """Other brands' deals of the last hours before the newest, of brands that contain ``part``, strongest first."""
    newest = F.broadcast(deals.agg(F.max("snapshot_datetime").alias("_newest")))
    rows = deals.where(F.col("brand") != own).join(newest, F.col("snapshot_datetime").cast("timestamp") >= F.timestamp_add("hour", F.lit(-hours), F.col("_newest").cast("timestamp"))).drop("_newest")
    rows = rows if part is None else rows.where(F.contains(F.lower("brand"), F.lit(part.lower())))
    return rows.orderBy(F.desc("discount_percent"), "asin")


def overview(deals: DataFrame) -> DataFrame:
    """One row over all deals."""
    return deals.agg(
        F.count("*").alias("deals"), F.count_if(F.col("deal_type") == "lightning").alias("lightning"), F.count_distinct("brand").alias("brands"), F.count_distinct(F.to_date("snapshot_datetime")).alias("days"),
        F.avg("discount_percent").alias("avg_discount"),
    )
