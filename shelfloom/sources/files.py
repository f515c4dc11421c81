"""Text sources: JSON lines with the numbers of bad ones, records by day, sheets of strings."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfloom.functions import scalars as X

from .tables import written


def json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """``(file, number, item, bad)`` of the lines of all files in a folder: the line's
    number in its file from 1, its fields, and the line itself if it isn't such an
    object (then ``item`` is null). Blank lines and those that begin with ``#`` are
    left out but counted.

    Large files are read in blocks by many tasks: a row knows its block and its
    place in its task, and a line's number is its place in the block after the
    lines of the blocks before, which are counted once (one row a block). Parsed
    rows are written on the way, so that places don't change between both uses."""
    place = F.monotonically_increasing_id()  # consecutive within a block, as one task reads it through
    raw = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"), F.trim("value").alias("line"))
    parsed = F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    names = StructType.fromDDL(schema).names
    rows = raw.withColumn("x", parsed).withColumn("kept", ~F.col("line").rlike(r"^\s*(#|$)"))
    fine = F.col("x._bad").isNull() & F.col("line").startswith("{")
    rows = written(rows.select("file", "block", "place", "kept", F.when(F.col("kept") & fine, F.struct(*(F.col(f"x.{n}") for n in names))).alias("item"), F.when(F.col("kept") & ~fine, F.col("line")).alias("bad")))
    blocks = rows.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return rows.where("kept").join(starts, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("number"), "item", "bad")


def line_problems(lines: DataFrame, key: str, needed: str) -> DataFrame:
    """``(file, number, problem)`` of JSON lines: not an object of the schema, no key,
    a key seen before (by file, then number), nothing in ``needed``. One row a
    problem. Repeated keys are found by the first place of each, which combines
    before the shuffle."""
    rows = lines.select("file", "number", F.col("bad").isNotNull().alias("broken"), F.col(f"item.{key}").cast("string").alias("key"), F.coalesce(F.col(f"item.{needed}").cast("string").rlike(r"\S"), F.lit(False)).alias("filled"))
    none = ~F.coalesce(F.col("key").rlike(r"\S"), F.lit(False))
    place = F.struct("file", "number")
    first = rows.where(~none).groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    found = F.array(F.when(F.col("broken"), "broken line"), F.when(~F.col("broken") & none, "no key"), F.when(place != F.col("first"), "repeated key"), F.when(~F.col("broken") & ~F.col("filled"), "empty field"))
    return rows.join(first, "key", "left").select("file", "number", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def save_records(rows: DataFrame, folder: str, day: str = "snapshot_date") -> None:
    """Records as JSON lines by day; the days of ``rows`` replace what is stored of them, other days keep their files."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).json(folder)


def recent_records(spark: SparkSession, folder: str, schema: StructType, until: datetime.date, days: int, day: str = "snapshot_date") -> DataFrame:
    """Stored records from ``days`` before ``until`` on; files of earlier days aren't opened."""
    return spark.read.schema(schema).json(folder).where(F.col(day) >= F.lit(until - datetime.timedelta(days=days)))


def sheet(spark: SparkSession, folder: str, columns: list[str], since: str, until: str, brand: str | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a sheet (CSV with a header, every cell a string; cells that a short
    row lacks are empty) by day, both ends included. The days and ``where``
    (other columns than the brand) reach the parser; a brand is brought to its full
    name first and then compared, whatever its case."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("escape", '"').csv(folder).where(F.col("snapshot_date").between(since, until))
    if where is not None:
        rows = rows.where(where)
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})
    rows = rows.withColumn("brand", X.normal_brand(F.col("brand"), F.col("product_name")))
    return rows if brand is None else rows.where(F.lower("brand") == brand.lower())
