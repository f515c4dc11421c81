"""Period, dashboard and request analytics over ranked snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shelf import known_brand, top

DATE = "snapshot_date"


def is_target(target: str) -> Column:
    """Brand or title names the target, whatever the case."""
    t = target.upper()
    return F.upper("brand").contains(t) | F.upper("product_name").contains(t)


def target_profile(shelf: DataFrame, target: str) -> DataFrame:
    """Daily share of the target: average, first, last, change and relative change."""
    daily = shelf.groupBy(DATE).agg((F.count_if(is_target(target)) / F.count("*")).alias("sos"))
    edge = daily.agg(F.avg("sos").alias("avg_sos"), F.min_by("sos", DATE).alias("start_sos"), F.max_by("sos", DATE).alias("end_sos"), F.count("*").alias("days"))
    change = F.col("end_sos") - F.col("start_sos")
    return edge.withColumns({"change": change, "change_percent": F.when(F.col("start_sos") > 0, 100 * change / F.col("start_sos"))})


def product_moves(shelf: DataFrame) -> DataFrame:
    """First and last rank of products seen at least twice; positive moves are rises."""
    per = shelf.groupBy("category_id", "asin").agg(F.min_by("rank", DATE).alias("start_rank"), F.max_by("rank", DATE).alias("end_rank"), F.count("*").alias("seen"), F.max("brand").alias("brand"))
    return per.where("seen >= 2").withColumn("move", F.col("start_rank") - F.col("end_rank"))


def movers(shelf: DataFrame, k: int = 10, least: int = 5) -> DataFrame:
    """The k strongest risers and fallers, ties by category and product."""
    moves = product_moves(shelf).where(F.abs("move") > least)
    up = moves.where("move > 0").orderBy(F.desc("move"), "category_id", "asin").limit(k).withColumn("kind", F.lit("riser"))
    down = moves.where("move < 0").orderBy("move", "category_id", "asin").limit(k).withColumn("kind", F.lit("faller"))
    return up.unionByName(down)


def brand_performance(shelf: DataFrame, k: int = 20) -> DataFrame:
    """Top brands by average daily share; a day without the brand counts as 0.
    Zero days need no grid: sums divide by the number of days."""
    counts = shelf.groupBy(DATE, "brand").agg(F.count("*").alias("c"))
    totals = shelf.groupBy(DATE).agg(F.count("*").alias("n"))
    span = totals.agg(F.count("*").alias("days"), F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    shares = counts.join(totals, DATE).withColumn("s", F.col("c") / F.col("n"))
    return (
        shares.crossJoin(F.broadcast(span)).groupBy("brand")
        .agg(
            (F.sum("s") / F.max("days")).alias("avg_sos"), F.coalesce(F.max(F.when(F.col(DATE) == F.col("first"), F.col("s"))), F.lit(0.0)).alias("start_sos"),
            F.coalesce(F.max(F.when(F.col(DATE) == F.col("last"), F.col("s"))), F.lit(0.0)).alias("end_sos"), (F.sum("c") / F.max("days")).alias("avg_products"), F.count("*").alias("appearances"),
        )
        .withColumn("change", F.col("end_sos") - F.col("start_sos")).orderBy(F.desc(F.round("avg_sos", 9)), "brand").limit(k)
    )


def competitive_shifts(shelf: DataFrame) -> DataFrame:
    """Brands that came or went between the first and the last snapshot, per category."""
    edge = Window.partitionBy("category_id")
    rows = shelf.select("category_id", DATE, "brand").distinct().withColumns({"lo": F.min(DATE).over(edge), "hi": F.max(DATE).over(edge)})
    sides = rows.where((F.col(DATE) == F.col("lo")) | (F.col(DATE) == F.col("hi"))).groupBy("category_id", "brand").agg(
        F.max((F.col(DATE) == F.col("lo")).cast("int")).alias("first"), F.max((F.col(DATE) == F.col("hi")).cast("int")).alias("last")
    )
    return sides.where("first <> last").select("category_id", "brand", F.when(F.col("first") == 1, "exited").otherwise("entered").alias("shift"))


def daily_trends(shelf: DataFrame, target: str) -> DataFrame:
    """Share, product and brand counts, concentration in points (unknown brands included)."""
    per = shelf.groupBy(DATE, "brand").agg(F.count("*").alias("c"), F.count_if(is_target(target)).alias("t"))
    s = F.col("c") / F.col("n")
    return per.withColumn("n", F.sum("c").over(Window.partitionBy(DATE))).groupBy(DATE).agg(
        (F.sum("t") / F.sum("c")).alias("sos"), F.sum("c").alias("products"), F.count("*").alias("brand_count"), (F.sum(s * s) * 10000).alias("hhi")
    )


def category_kpi(shelf: DataFrame, target: str) -> DataFrame:
    """Per category over the latest snapshot of all: share, best rank (999 without), price index (100 without)."""
    latest = shelf.join(F.broadcast(shelf.agg(F.max(DATE).alias(DATE))), DATE)
    mine = is_target(target)
    price = F.when(F.col("price") > 0, F.col("price"))
    return latest.groupBy("category_id").agg(
        (F.count_if(mine) / F.count("*")).alias("sos"), F.coalesce(F.min(F.when(mine, F.col("rank"))), F.lit(999)).alias("best_rank"),
        F.coalesce(100 * F.avg(F.when(mine, price)) / F.avg(price), F.lit(100.0)).alias("cpi"), F.count_if(mine).alias("own_products"), F.count_distinct("brand").alias("brands"),
    )


def sos_by_category(shelf: DataFrame) -> DataFrame:
    """Brand share per category over the whole period, with days and rate of appearance."""
    days = shelf.groupBy("category_id").agg(F.count_distinct(DATE).alias("days"), F.count("*").alias("n"))
    per = shelf.groupBy("category_id", "brand").agg(F.count("*").alias("c"), F.count_distinct(DATE).alias("appeared"))
    return per.join(days, "category_id").select("category_id", "brand", (F.col("c") / F.col("n")).alias("sos"), "appeared", (F.col("appeared") / F.col("days")).alias("appearance_rate"))


def available_brands(shelf: DataFrame, least_products: int = 3) -> DataFrame:
    return shelf.groupBy("brand").agg(F.count_distinct("asin").alias("products"), F.count_distinct(DATE).alias("days")).where(F.col("products") >= least_products)


def sos_trend(shelf: DataFrame, brand: str) -> DataFrame:
    """Day totals left-joined with the brand's counts; a day without it is 0."""
    totals = shelf.groupBy(DATE).agg(F.count("*").alias("total"))
    own = shelf.where(F.lower("brand").contains(brand.lower())).groupBy(DATE).agg(F.count("*").alias("own"))
    return totals.join(own, DATE, "left").select(DATE, F.coalesce("own", F.lit(0)).alias("own"), "total", (F.coalesce("own", F.lit(0)) / F.col("total")).alias("sos"))


def competitor_avg_sos(shelf: DataFrame, brand: str, n: int = 5) -> DataFrame:
    """Average share of each day's n strongest other brands."""
    total = Window.partitionBy(DATE)
    per = shelf.groupBy(DATE, "brand").agg(F.count("*").alias("c")).withColumn("s", F.col("c") / F.sum("c").over(total))
    rivals = per.where(known_brand() & ~F.lower("brand").contains(brand.lower()))
    return rivals.withColumn("place", F.row_number().over(total.orderBy(F.desc("c"), "brand"))).where(F.col("place") <= n).groupBy(DATE).agg(F.avg("s").alias("avg_sos"), F.count("*").alias("brands"))


def period_brand_metrics(shelf: DataFrame, forced: str, k: int = 10, least_total: int = 100) -> DataFrame:
    """Top brands by distinct products plus a forced brand; shares over at least ``least_total``."""
    total = F.broadcast(shelf.agg(F.greatest(F.count_distinct("asin"), F.lit(least_total)).alias("total")))
    per = shelf.groupBy("brand").agg(F.count_distinct("asin").alias("products"), F.avg("rank").alias("avg_rank"), F.avg("price").alias("avg_price"))
    place = F.row_number().over(Window.orderBy(F.desc("products"), "brand"))
    return per.withColumn("place", place).where((F.col("place") <= k) | (F.col("brand") == forced)).crossJoin(total).select("brand", "products", "avg_rank", "avg_price", (F.col("products") / F.col("total")).alias("share"))


def action_items(history: DataFrame) -> DataFrame:
    """Best row per product of the latest snapshot, first matching signal, priority."""
    latest = history.join(F.broadcast(history.agg(F.max(DATE).alias(DATE))), DATE)
    best = latest.withColumn("rn", F.row_number().over(Window.partitionBy("asin").orderBy("rank", "category_id"))).where("rn = 1")
    change = F.coalesce("rank_change", F.lit(0))
    signal = F.when(change >= 10, "sharp_drop").when(change <= -10, "sharp_rise").when(F.col("rank") <= 5, "leader").when(F.col("rank") <= 20, "contender").otherwise("watch")
    priority = F.when(F.col("rank") <= 5, "P1").when(F.col("rank") <= 20, "P2").otherwise("P3")
    return best.select("asin", "category_id", "rank", change.alias("change"), signal.alias("signal"), priority.alias("priority"))


def product_view(history: DataFrame) -> DataFrame:
    """Latest row of each product with volatility band and place in the rank/volatility quadrant."""
    newest = Window.partitionBy("category_id", "asin").orderBy(F.desc(DATE))
    v = F.coalesce("volatility", F.lit(0.0))
    band = F.when(v < 3, "stable").when(v < 10, "moving").otherwise("volatile")
    quadrant = F.when((F.col("rank") <= 10) & (v < 15), "steady leader").when(F.col("rank") <= 10, "shaky leader").when(v < 15, "steady follower").otherwise("shaky follower")
    return history.withColumn("rn", F.row_number().over(newest)).where("rn = 1").select("category_id", "asin", "rank", band.alias("band"), quadrant.alias("quadrant"))


def product_share(shelf: DataFrame, k: int = 5) -> DataFrame:
    """Weights max(1, 100 - rank) of the k best products, the rest as Others, per category (latest snapshot)."""
    latest = shelf.join(F.broadcast(shelf.agg(F.max(DATE).alias(DATE))), DATE)
    w = F.greatest(F.lit(1), 100 - F.col("rank"))
    named = latest.select("category_id", F.when(F.col("rank") <= k, F.col("asin").cast("string")).otherwise("Others").alias("product"), w.alias("w"))
    return named.groupBy("category_id", "product").agg(F.sum("w").alias("weight")).withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("category_id")))


def brand_matrix(shelf: DataFrame, k: int = 10) -> DataFrame:
    per = shelf.groupBy("brand").agg(F.count("*").alias("products"), F.avg("rank").alias("avg_rank"), F.avg("rating").alias("avg_rating")).where("products >= 2")
    return per.orderBy(F.desc("products"), "brand").limit(k)


def recent_trend(shelf: DataFrame, target: str, n: int = 14) -> DataFrame:
    """Share on the last n distinct dates."""
    daily = shelf.groupBy(DATE).agg((F.count_if(is_target(target)) / F.count("*")).alias("sos"))
    return daily.orderBy(F.desc(DATE)).limit(n)


def rank_series(shelf: DataFrame, dates: list | None = None) -> DataFrame:
    """Products against the given dates: best rank of each (pivot). Without
    dates every snapshot month has a column; the driver holds their names."""
    named = shelf.withColumn("d", F.date_format(DATE, "yyyyMM"))
    if dates is None:
        dates = [r.d for r in named.select("d").distinct().orderBy("d").collect()]
    return named.groupBy("asin").pivot("d", dates).agg(F.min("rank")).toDF("asin", *(f"r{d}" for d in dates))


def discount_trend(shelf: DataFrame) -> DataFrame:
    return shelf.groupBy(DATE, "category_id").agg(F.avg("discount_percent").alias("avg_discount"), F.min_by("discount_percent", "rank").alias("best_product_discount"), F.max("discount_percent").alias("max_discount"))


def growth_types(shelf: DataFrame, promoted: float = 15.0) -> DataFrame:
    kind = F.when(F.col("discount_percent") > promoted, "promotion").otherwise("organic")
    return shelf.groupBy("category_id", kind.alias("growth")).agg(F.count("*").alias("rows"))


def duplicate_groups(shelf: DataFrame) -> DataFrame:
    return shelf.groupBy(DATE, "asin", "category_id").agg(F.count("*").alias("n")).where("n > 1")


def grouping_report(shelf: DataFrame) -> DataFrame:
    """Counts by category and brand with subtotals in one pass."""
    return shelf.cube("category_id", "brand").agg(F.count("*").alias("rows"), F.min("rank").alias("best_rank"), F.grouping_id().alias("level"))


def surges(shelf: DataFrame, steps: int = 3, gain: int = 20) -> DataFrame:
    """Extension: products that gained ``gain`` ranks over ``steps`` snapshots."""
    w = Window.partitionBy("category_id", "asin").orderBy(DATE)
    return shelf.withColumn("gain", F.lag("rank", steps).over(w) - F.col("rank")).where(F.col("gain") >= gain).select(DATE, "category_id", "asin", "rank", "gain")


def presence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sources' counts per date, 0 where one has none."""
    a, b = left.groupBy(DATE).agg(F.count("*").alias("left_rows")), right.groupBy(DATE).agg(F.count("*").alias("right_rows"))
    return a.join(b, DATE, "full_outer").select(DATE, F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Last writer wins on the key: new rows replace old ones. Of several new rows
    of a key the largest in ``order`` (all other columns by default) is the last."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rest = order or [c for c in both.columns if c not in (*keys, "_seq")]
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*map(F.desc_nulls_last, ["_seq", *rest])))).where("_rn = 1").drop("_seq", "_rn")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """First writer wins: only keys not yet there are added, each once (the row
    that is least in ``order``, all other columns by default)."""
    rest = order or [c for c in new.columns if c not in keys]
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*map(F.asc_nulls_last, rest or keys)))).where("_rn = 1").drop("_rn")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def overlaps(left: DataFrame, right: DataFrame, key: str, start: str, end: str, span_days: int) -> DataFrame:
    """Left rows whose period overlaps one of the right with the same key. Periods
    are cut into buckets of ``span_days``, so the join is on equality and a
    hot key spreads over its buckets."""
    bucket = lambda c: F.floor(F.unix_date(F.col(c).cast("date")) / span_days)
    cut = lambda d: d.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    a, b = cut(left).alias("a"), cut(right).alias("b")
    meets = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._b") == F.col("b._b")) & (F.col(f"b.{start}") <= F.col(f"a.{end}")) & (F.col(f"b.{end}") >= F.col(f"a.{start}"))
    return a.join(b, meets, "left_semi").drop("_b").distinct()


def concentration_label(daily: DataFrame, value: str = "hhi") -> DataFrame:
    """Mean of daily concentration in points and its label: competitive below 1,500, moderate below 2,500."""
    mean = daily.agg(F.avg(value).alias("avg_hhi"))
    return mean.withColumn("label", F.when(F.col("avg_hhi") < 1500, "competitive").when(F.col("avg_hhi") < 2500, "moderate").otherwise("concentrated"))


def frequent(shelf: DataFrame, last: int = 7, least: int = 5, rank: int = 20) -> DataFrame:
    """Extension: products with at least ``least`` rows up to ``rank`` within the last ``last`` snapshots of all."""
    dates = shelf.select(DATE).distinct().orderBy(F.desc(DATE)).limit(last)
    rows = shelf.where(F.col("rank") <= rank).join(F.broadcast(dates), DATE)
    return rows.groupBy("category_id", "asin").agg(F.count("*").alias("seen")).where(F.col("seen") >= least)


def promoted_gains(shelf: DataFrame, discount: float = 30.0, gain: int = 10) -> DataFrame:
    """Extension: rows with a discount of at least ``discount`` that gained ``gain`` ranks since the product's row before."""
    order = Window.partitionBy("category_id", "asin").orderBy(DATE)
    return shelf.withColumn("gain", F.lag("rank").over(order) - F.col("rank")).where((F.col("gain") >= gain) & (F.col("discount_percent") >= discount)).select(DATE, "category_id", "asin", "gain")
