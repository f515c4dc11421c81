"""Tables and the derived views that the operators read.

The views map a star schema to ranked product snapshots, promotions, triples and
run events. Money is summed in whole cents and discounts in whole percent, so
sums are exact and don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import dealt

TOP_N = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sold_rows(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``lineitem``, from the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def shelf(spark: SparkSession, sf_dir: str, top_n: int = TOP_N, since=None) -> DataFrame:
    """Monthly ranking of products per category: one row per (snapshot_date,
    category_id, rank); from the month of ``since`` on, if given: earlier sales
    are left out by the scan."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    sold = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag")
    if since is not None:
        sold = sold.where(F.col("l_shipdate") >= F.lit(since.replace(day=1, hour=0, minute=0, second=0, microsecond=0)))
    # a product's sales meet in one task, of bounded size; nothing is gained by summing before
    # that. Part facts are aggregated before the join, so it sees one row per product and month
    monthly = dealt(sold, "l_partkey", sold_rows(spark, sf_dir)).groupBy(F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("snapshot_date"), "l_partkey").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
        F.sum(F.col("l_quantity").cast("long")).alias("units"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discounts"),
        F.count("*").alias("reviews_count"),
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("returned"),
    )
    rank = F.row_number().over(Window.partitionBy("snapshot_date", "category_id").orderBy(F.desc("cents"), "asin"))
    return (
        monthly.join(part, monthly.l_partkey == part.p_partkey)
        .select(
            "snapshot_date", F.col("p_type").alias("category_id"), F.col("p_partkey").alias("asin"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), "cents",
            (F.col("cents") / 100.0 / F.col("units")).alias("price"), F.col("p_retailprice").alias("list_price"),
            (F.col("discounts") / F.col("reviews_count")).alias("discount_percent"), (5.0 * (1.0 - F.col("returned") / F.col("reviews_count"))).alias("rating"), "reviews_count",
        )
        .withColumn("rank", rank).where(F.col("rank") <= top_n).drop("cents")
    )


def latest_shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest month of ``shelf``, without a pass over the others."""
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").cast("timestamp")).first()[0]
    return shelf(spark, sf_dir, since=last)


SHELF_SQL = """monthly AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS snapshot_date, l_partkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(l_quantity AS BIGINT)) AS units,
         sum(CAST(round(l_discount * 100) AS BIGINT)) AS discounts, count(*) AS reviews_count, count(*) FILTER (l_returnflag = 'R') AS returned
  FROM lineitem GROUP BY 1, 2),
shelf AS (
  SELECT snapshot_date, p_type AS category_id, p_partkey AS asin, p_name AS product_name, p_brand AS brand, cents / 100.0::DOUBLE / units AS price, p_retailprice AS list_price,
         discounts::DOUBLE / reviews_count AS discount_percent, 5.0::DOUBLE * (1.0::DOUBLE - returned::DOUBLE / reviews_count) AS rating, reviews_count,
         row_number() OVER (PARTITION BY snapshot_date, p_type ORDER BY cents DESC, p_partkey)::INT AS rank
  FROM monthly JOIN part ON l_partkey = p_partkey QUALIFY rank <= 100)"""


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions: discounted sales with a deal type."""
    sold = table(spark, sf_dir, "lineitem").where("l_discount > 0").select("l_partkey", "l_shipdate", "l_discount", "l_linestatus", "l_returnflag", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    kind = F.when(F.col("l_returnflag") == "R", "lightning").when(F.col("l_returnflag") == "A", "deal_of_day").when(F.col("l_linestatus") == "O", "best_deal").otherwise("coupon")
    return sold.join(part, sold.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").alias("snapshot_datetime"), F.col("p_partkey").alias("asin"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.round(F.col("l_discount") * 100).cast("long").alias("discount_percent"), kind.alias("deal_type"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("deal_price"),
    )


DEALS_SQL = """deals AS (
  SELECT l_shipdate AS snapshot_datetime, p_partkey AS asin, p_name AS product_name, p_brand AS brand, p_type AS category, CAST(round(l_discount * 100) AS BIGINT) AS discount_percent,
         CASE WHEN l_returnflag = 'R' THEN 'lightning' WHEN l_returnflag = 'A' THEN 'deal_of_day' WHEN l_linestatus = 'O' THEN 'best_deal' ELSE 'coupon' END AS deal_type,
         l_extendedprice / l_quantity AS deal_price
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount > 0)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (subject, predicate, object, confidence) of the knowledge graph."""
    part, supplier, nation, region = (table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region"))
    place = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    pid = F.concat(F.lit("P"), F.col("p_partkey"))
    some = part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    ranked = some.withColumn("pos", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("n"), "p_brand"))).where("pos <= 10")
    a, b = ranked.alias("a"), ranked.alias("b")
    rivals = a.join(b, (F.col("a.p_type") == F.col("b.p_type")) & (F.col("a.pos") != F.col("b.pos")))
    direct = F.when((F.col("a.pos") <= 5) & (F.col("b.pos") <= 5), "directCompetitor").otherwise("indirectCompetitor")
    edges = [
        part.select(F.col("p_brand").alias("subject"), F.lit("hasProduct").alias("predicate"), pid.alias("object"), F.lit(1.0).alias("confidence")),
        part.select(pid, F.lit("belongsToCategory"), F.col("p_type"), F.lit(1.0)),
        place.select("n_name", F.lit("parentCategory"), "r_name", F.lit(1.0)), place.select("r_name", F.lit("hasSubcategory"), "n_name", F.lit(1.0)),
        supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).select("s_name", F.lit("originatesFrom"), "n_name", F.lit(0.9)),
        rivals.select(F.col("a.p_brand"), direct, F.col("b.p_brand"), F.lit(0.8)).distinct(),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


TRIPLES_SQL = """ranked AS (SELECT p_type, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS pos FROM part GROUP BY 1, 2 QUALIFY pos <= 10),
triples AS (
  SELECT p_brand AS subject, 'hasProduct' AS predicate, 'P' || p_partkey AS object, 1.0::DOUBLE AS confidence FROM part
  UNION ALL SELECT 'P' || p_partkey, 'belongsToCategory', p_type, 1.0 FROM part
  UNION ALL SELECT n_name, 'parentCategory', r_name, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name, 'hasSubcategory', n_name, 1.0 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'originatesFrom', n_name, 0.9 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT a.p_brand, CASE WHEN a.pos <= 5 AND b.pos <= 5 THEN 'directCompetitor' ELSE 'indirectCompetitor' END, b.p_brand, 0.8
            FROM ranked a JOIN ranked b ON a.p_type = b.p_type AND a.pos <> b.pos)"""


def runs(spark: SparkSession, sf_dir: str, gap_minutes: int = 30) -> DataFrame:
    """Events with a session number per user: a gap of 30 minutes starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double") > gap_minutes * 60
    return table(spark, sf_dir, "events").withColumn("session", F.sum(F.coalesce(gap.cast("int"), F.lit(1))).over(w))


RUNS_SQL = """runs0 AS (SELECT *, coalesce((epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800)::INT, 1) AS fresh FROM events),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM runs0)"""
