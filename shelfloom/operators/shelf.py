"""Shelf metrics: share of shelf, concentration, price index, churn, volatility.

Everything works on whole snapshots: one groupBy per grain and one window pass
per product history. Shares are fractions; empty inputs follow each metric's own
rule (share 0, average null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING_RANK = 999
TIERS = (3, 5, 10, 20, 50, 100)
GROUP = ["snapshot_date", "category_id"]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def top(rank: str = "rank", n: int = 100) -> Column:
    """A missing rank counts as outside every Top-N."""
    return F.coalesce(F.col(rank), F.lit(MISSING_RANK)) <= n


def known_brand(brand: str = "brand") -> Column:
    return F.col(brand).isNotNull() & (F.col(brand) != "") & (F.lower(brand) != "unknown")


#: Averages of doubles are taken over whole multiples of 1 / GRAIN, so they don't depend on the order of rows.
GRAIN = 1e6


def exact_sum(c: Column) -> Column:
    return F.sum(F.floor(c * GRAIN + 0.5).cast("long"))


def share_of_shelf(shelf: DataFrame, top_n: int = 100, keys: list[str] = GROUP) -> DataFrame:
    """Share of each brand among the Top-N products; unknown brands stay in the denominator."""
    counts = shelf.where(top(n=top_n)).groupBy(*keys, "brand").agg(F.count("*").alias("products"))
    total = F.sum("products").over(Window.partitionBy(*keys))
    return counts.withColumn("sos", F.col("products") / total)


def concentration(shelf: DataFrame, keys: list[str] = GROUP, scale: float = 1.0, unknown: str = "numerator", top_n: int = 100) -> DataFrame:
    """Herfindahl index. ``unknown`` brands are left out of the "numerator"
    only, of "both" sides, or of none ("keep"); ``scale`` 10000 gives points."""
    rows = shelf.where(top(n=top_n))
    if unknown == "both":
        rows = rows.where(known_brand())
    counts = rows.groupBy(*keys, "brand").agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    counted = known_brand() if unknown == "numerator" else F.lit(True)
    return counts.withColumn("s", F.when(counted, F.col("c") / total).otherwise(0.0)).groupBy(*keys).agg((F.sum(F.col("s") * F.col("s")) * scale).alias("hhi"))


def brand_metrics(shelf: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Share, average rank, price index, rating gap and tier counts of every
    brand in one aggregation; market averages come from a window over its rows."""
    price, rating = F.when(F.col("price") > 0, F.col("price")), F.when(F.col("rating") > 0, F.col("rating"))
    per = shelf.groupBy(*keys, "brand").agg(
        F.count("*").alias("products"), F.avg("rank").alias("avg_rank"), F.min("rank").alias("best_rank"), exact_sum(price).alias("ps"), F.count(price).alias("pc"),
        exact_sum(rating).alias("rs"), F.count(rating).alias("rc"), F.count_if(top(n=10)).alias("top10"), F.count_if(top(n=20)).alias("top20"),
    )
    w = Window.partitionBy(*keys)
    share = lambda s, c: F.when(F.col(c) > 0, F.col(s) / F.col(c) / GRAIN)
    market = lambda s, c: F.sum(s).over(w) / F.sum(c).over(w) / GRAIN
    return per.select(
        *keys, "brand", "products", (F.col("products") / F.sum("products").over(w)).alias("sos"), "avg_rank", "best_rank", "top10", "top20",
        (100 * share("ps", "pc") / market("ps", "pc")).alias("cpi"), (share("rs", "rc") - market("rs", "rc")).alias("rating_gap"),
    )


def churn(shelf: DataFrame, top_n: int = 100) -> DataFrame:
    """Share of Top-N products that came or went since the previous snapshot of
    the category, over twice N; 0 for the first snapshot. Found by two shifts of
    the category's snapshot order and no self-join of the days."""
    dates = shelf.select(*GROUP).distinct()
    order = Window.partitionBy("category_id").orderBy("snapshot_date")
    steps = dates.select(*GROUP, F.lag("snapshot_date").over(order).alias("before"))
    rows = shelf.where(top(n=top_n)).select(*GROUP, "asin")
    now = rows.join(steps, GROUP).select("category_id", F.col("snapshot_date").alias("at"), "asin", F.lit(1).alias("today"), F.lit(0).alias("yesterday"), F.col("before").isNotNull().alias("real"))
    was = rows.join(steps.select("category_id", F.col("before").alias("snapshot_date"), F.col("snapshot_date").alias("at")), GROUP).select("category_id", "at", "asin", F.lit(0), F.lit(1), F.lit(True))
    each = now.union(was).groupBy("category_id", "at", "asin").agg(F.max("today").alias("t"), F.max("yesterday").alias("y"), F.max("real").alias("real"))
    gone = F.count_if((F.col("t") == 0) & F.col("real"))
    new = F.count_if((F.col("y") == 0) & F.col("real"))
    return each.groupBy(F.col("at").alias("snapshot_date"), "category_id").agg(new.alias("entered"), gone.alias("left"), ((new + gone) / (2.0 * top_n)).alias("churn_rate"))


def product_history(shelf: DataFrame, window: int = 7, shock: int = 5, streak_n: int = 10, promoted: float = 5.0) -> DataFrame:
    """Per product and snapshot: rank change, shock, volatility, streak, rating
    trend and best rank, all from one sort of the product's history. Price change
    over ``window`` snapshots; so far, the share of rises with a discount above
    ``promoted`` (overlap) and of steps with a rise and a larger discount (score)."""
    history = Window.partitionBy("category_id", "asin").orderBy("snapshot_date")
    last = history.rowsBetween(-(window - 1), 0)
    so_far = history.rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(last)
    x, y = F.col("idx").cast("double"), F.when(F.col("rating") > 0, F.col("rating"))
    rows = shelf.withColumn("idx", F.row_number().over(history)).withColumn("miss", F.sum((~top(n=streak_n)).cast("int")).over(so_far))
    change = F.col("rank") - F.lag("rank").over(history)
    streak = F.sum(top(n=streak_n).cast("int")).over(Window.partitionBy("category_id", "asin", "miss").orderBy("snapshot_date").rowsBetween(Window.unboundedPreceding, 0))
    rose = F.coalesce(change < 0, F.lit(False))
    rows = rows.withColumns({"rose": rose, "rose_promoted": rose & (F.col("discount_percent") > promoted), "rose_cheaper": rose & F.coalesce(F.col("discount_percent") > F.lag("discount_percent").over(history), F.lit(False))})
    times = lambda c: F.sum(F.col(c).cast("int")).over(so_far)
    return rows.select(
        *GROUP, "asin", "brand", "rank", "price", "rating", "reviews_count", change.alias("rank_change"), (F.col("rank") - F.lag("rank", window).over(history)).alias("rank_change_7"),
        F.coalesce(F.abs(change) >= shock, F.lit(False)).alias("rank_shock"), F.when(n >= 2, F.stddev_pop("rank").over(last)).alias("volatility"),
        F.when(n >= 2, F.covar_pop(x, y).over(last) / F.nullif(F.var_pop(x).over(last), F.lit(0.0))).alias("rating_trend"), streak.alias("streak"), F.min("rank").over(so_far).alias("best_rank"),
        (F.max("rank").over(last) - F.min("rank").over(last)).alias("rank_range"), (F.col("price") / F.nullif(F.lag("price", window).over(history), F.lit(0.0)) - 1).alias("price_change"),
        (times("rose_promoted") / F.nullif(times("rose"), F.lit(0))).alias("discount_overlap"), (times("rose_cheaper") / F.nullif(F.col("idx") - 1, F.lit(0))).alias("discount_score"),
    )


def days_in_top(shelf: DataFrame, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Snapshots that each product spent in every tier."""
    return shelf.groupBy("category_id", "asin").agg(*(F.count_if(top(n=t)).alias(f"top{t}") for t in tiers), F.min("rank").alias("best_rank"))


def market_metrics(shelf: DataFrame) -> DataFrame:
    """Concentration, leader with its share, average price and rating, rating spread."""
    per = shelf.groupBy(*GROUP, "brand").agg(F.count("*").alias("c"), exact_sum(F.col("price")).alias("p"), exact_sum(F.col("rating")).alias("r"))
    total = F.sum("c").over(Window.partitionBy(*GROUP))
    s = F.col("c") / F.col("n")
    order = Window.partitionBy(*GROUP).orderBy(F.desc("c"), "brand")
    return (
        per.withColumn("n", total).withColumn("place", F.row_number().over(order)).groupBy(*GROUP)
        .agg(
            F.sum(s * s).alias("hhi"), F.max(F.when(F.col("place") == 1, F.col("brand"))).alias("top_brand"), F.max(F.when(F.col("place") == 1, s)).alias("top_share"),
            (F.sum("p") / F.sum("c") / GRAIN).alias("avg_price"), (F.sum("r") / F.sum("c") / GRAIN).alias("avg_rating"), ((F.max(F.col("r") / F.col("c")) - F.min(F.col("r") / F.col("c"))) / GRAIN).alias("rating_spread"),
        )
    )


def metric_alerts(history: DataFrame) -> DataFrame:
    """Alert rows of product histories: drops (critical from 10), entries into the Top 10, shocks."""
    before = F.col("rank") - F.col("rank_change")
    found = F.array(
        F.when(F.col("rank_change") >= 10, F.struct(F.lit("rank_drop").alias("alert"), F.lit("critical").alias("severity"))).when(F.col("rank_change") >= 5, F.struct(F.lit("rank_drop").alias("alert"), F.lit("warning").alias("severity"))),
        F.when((F.col("rank") <= 10) & (before > 10), F.struct(F.lit("top10_entry").alias("alert"), F.lit("info").alias("severity"))),
        F.when(F.col("rank_shock"), F.struct(F.lit("rank_shock").alias("alert"), F.lit("warning").alias("severity"))),
    )
    return history.select(*GROUP, "asin", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select(*GROUP, "asin", "a.*")


def best_products(history: DataFrame) -> DataFrame:
    """Per brand: the history figures of its best ranked product of the snapshot,
    and whether any of its products had a shock."""
    names = "rank_change rank_change_7 volatility streak rating_trend price_change discount_overlap discount_score".split()
    best = F.min_by(F.struct(*names, F.col("reviews_count").alias("reviews")), "rank")
    return history.groupBy(*GROUP, "brand").agg(best.alias("best"), F.bool_or("rank_shock").alias("rank_shock")).select(*GROUP, "brand", "best.*", "rank_shock")
