"""Dashboard rows over ranked snapshots: status, briefs, comparisons and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DATE = "snapshot_date"
MISSING = 100


def at_latest(rows: DataFrame, date: str = DATE) -> DataFrame:
    """Rows of the last date of the whole table (not of each category)."""
    return rows.join(F.broadcast(rows.agg(F.max(date).alias(date))), date)  # one row


def history(shelf: DataFrame, days: int = 30, cap: int = 10_000) -> DataFrame:
    """Rows of the last ``days`` before the newest snapshot, newest first."""
    newest = F.broadcast(shelf.agg(F.max(DATE).alias("_newest")))
    rows = shelf.join(newest, F.col(DATE) >= F.date_sub("_newest", days)).drop("_newest")
    return rows.orderBy(F.desc(DATE), "category_id", "rank").limit(cap)


def products_of(shelf: DataFrame, brand: str | None = None, date: str | None = None) -> DataFrame:
    """Products of a brand (exact name) on a date, the latest by default."""
    rows = at_latest(shelf) if date is None else shelf.where(F.col(DATE) == F.lit(date).cast("date"))
    return rows if brand is None else rows.where(F.col("brand") == brand)


def category_share_average(shelf: DataFrame, mine: Column) -> DataFrame:
    """Mean daily share per category, over the days on which the category appears."""
    daily = shelf.groupBy("category_id", DATE).agg((F.count_if(mine) / F.count("*")).alias("sos"))
    return daily.groupBy("category_id").agg(F.avg("sos").alias("avg_sos"), F.count("*").alias("days"))


def daily_history(shelf: DataFrame, mine: Column, whole: int = 100) -> DataFrame:
    """Per day: share over a constant, average rank, number in the Top 10."""
    return shelf.where(mine).groupBy(DATE).agg((F.count("*") / whole).alias("sos"), F.avg("rank").alias("avg_rank"), F.count_if(F.col("rank") <= 10).alias("top10"))


def priority(rank: Column) -> Column:
    return F.when(rank <= 5, "P1").when(rank <= 20, "P2").otherwise("P3")


def home_status(shelf: DataFrame, mine: Column) -> DataFrame:
    """One row: how many of the target's products are in a Top 10 now, as a word."""
    n = at_latest(shelf).agg(F.count_if(mine & (F.col("rank") <= 10)).alias("top10"))
    return n.select("top10", F.when(F.col("top10") >= 3, "strong").when(F.col("top10") >= 1, "present").otherwise("absent").alias("status"))


def since_oldest(shelf: DataFrame) -> DataFrame:
    """Change of rank between a product's row and its earliest earlier one, null on the first."""
    order = Window.partitionBy("category_id", "asin").orderBy(DATE)
    first = F.first_value("rank").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return shelf.select(DATE, "category_id", "asin", "rank", first.alias("first_rank"), (F.col("rank") - first).alias("change"))


def since_previous(shelf: DataFrame, missing: int = MISSING) -> DataFrame:
    """Change of rank since the category's previous snapshot; a product that it
    lacks had rank ``missing`` there. The first snapshot has no row."""
    order = Window.partitionBy("category_id").orderBy(DATE)
    steps = shelf.select("category_id", DATE).distinct().withColumn("_before", F.lag(DATE).over(order)).where("_before is not null")
    before = shelf.select("category_id", "asin", F.col(DATE).alias("_before"), F.col("rank").alias("_prior"))
    rows = shelf.join(steps, ["category_id", DATE]).join(before, ["category_id", "asin", "_before"], "left")
    prior = F.coalesce("_prior", F.lit(missing))
    return rows.select(DATE, "category_id", "asin", "brand", "rank", prior.alias("prior"), (prior - F.col("rank")).alias("gain"))


def against_own(theirs: DataFrame, own: DataFrame, kind: str) -> DataFrame:
    """Every row of ``theirs`` beside the first own product of its kind (best rank,
    then least asin), with differences of price and rating; null without one."""
    first = Window.partitionBy(kind).orderBy("rank", "asin")
    one = own.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(kind, F.col("asin").alias("own_asin"), F.col("price").alias("_price"), F.col("rating").alias("_rating"))
    return theirs.join(one, kind, "left").select("category_id", "asin", "brand", "own_asin", (F.col("price") - F.col("_price")).alias("price_gap"), (F.col("rating") - F.col("_rating")).alias("rating_gap"))


def brand_averages(rows: DataFrame, mine: Column) -> DataFrame:
    """Means of price and rating of every other brand, and their distance from the own ones."""
    own = F.broadcast(rows.where(mine).agg(F.avg("price").alias("_p"), F.avg("rating").alias("_r")))
    per = rows.where(~mine).groupBy("brand").agg(F.count("*").alias("products"), F.avg("price").alias("avg_price"), F.avg("rating").alias("avg_rating"))
    return per.join(own, how="cross").select("brand", "products", "avg_price", "avg_rating", (F.col("avg_price") - F.col("_p")).alias("price_gap"), (F.col("avg_rating") - F.col("_r")).alias("rating_gap"))


def latest_brands(shelf: DataFrame) -> DataFrame:
    """Figures over all dates of the brands that the latest snapshot has."""
    now = at_latest(shelf).select("brand").distinct()
    return shelf.join(now, "brand", "left_semi").groupBy("brand").agg(F.count("*").alias("rows"), F.avg("rank").alias("avg_rank"), F.min("rank").alias("best_rank"))


def summary(shelf: DataFrame, k: int = 20) -> DataFrame:
    """The k brands with most rows: share of all rows, average rank and rating, first and last date."""
    total = F.broadcast(shelf.agg(F.count("*").alias("_total")))
    per = shelf.groupBy("brand").agg(F.count("*").alias("rows"), F.avg("rank").alias("avg_rank"), F.avg("rating").alias("avg_rating"), F.min(DATE).alias("first"), F.max(DATE).alias("last"))
    return per.orderBy(F.desc("rows"), "brand").limit(k).join(total, how="cross").withColumn("share", F.col("rows") / F.col("_total")).drop("_total")


def brand_view(shelf: DataFrame, mine: Column) -> DataFrame:
    """KPIs of the target in the latest snapshot, with the change of its share since the one before."""
    daily = shelf.groupBy(DATE).agg(
        (F.count_if(mine) / F.count("*")).alias("sos"), F.count_if(mine).alias("products"), F.avg(F.when(mine, F.col("rank"))).alias("avg_rank"),
        F.count_if(mine & (F.col("rank") <= 10)).alias("top10"), F.avg(F.when(mine, F.col("price"))).alias("avg_price"),
    )
    # one row a snapshot
    last = daily.orderBy(F.desc(DATE)).limit(2).agg(F.max_by(F.struct("sos", "products", "avg_rank", "top10", "avg_price"), DATE).alias("v"), F.min_by("sos", DATE).alias("_before"), F.count("*").alias("_n"))
    return last.select("v.*", F.when(F.col("_n") == 2, F.col("v.sos") - F.col("_before")).alias("sos_delta"))


def competitor_list(shelf: DataFrame, mine: Column, tracked: list[str], organic: int = 7, most: int = 10) -> DataFrame:
    """The strongest other brands of the latest snapshot and all tracked ones, each once, ``most`` at most."""
    per = at_latest(shelf).where(~mine).groupBy("brand").agg(F.count("*").alias("products"), F.avg("rank").alias("avg_rank"))
    named = F.col("brand").isin(tracked)
    best = per.where(~named).orderBy(F.desc("products"), "brand").limit(organic).withColumn("kind", F.lit("organic"))
    both = best.unionByName(per.where(named).withColumn("kind", F.lit("tracked")))
    return both.orderBy(F.desc("products"), "brand").limit(most)


def price_index_trend(shelf: DataFrame, mine: Column, category: str) -> DataFrame:
    """Price index of the target per date in one category; 100 on a date without it."""
    price = F.when(F.col("price") > 0, F.col("price"))
    return shelf.where(F.col("category_id") == category).groupBy(DATE).agg(F.coalesce(100 * F.avg(F.when(mine, price)) / F.avg(price), F.lit(100.0)).alias("cpi"))


def promotions(shelf: DataFrame, mine: Column, above: float = 5.0, k: int = 15) -> DataFrame:
    """Other brands' promoted products in the latest snapshot."""
    on = F.col("discount_percent") > above
    per = at_latest(shelf).where(~mine).groupBy("brand").agg(F.count("*").alias("products"), F.count_if(on).alias("promoted"), F.max("discount_percent").alias("max_discount"))
    return per.where("promoted > 0").orderBy(F.desc("promoted"), F.desc("max_discount"), "brand").limit(k)


def morning_brief(shelf: DataFrame, mine: Column, move: int = 10) -> DataFrame:
    """Rows of the brief of the latest snapshot: movers of ``move`` ranks and more
    among the first 50, and the target's products of rank 1 to 5."""
    rows = at_latest(since_previous(shelf))
    kinds = F.array(
        F.when((F.col("rank") <= 50) & (F.col("gain") >= move), "riser").when((F.col("rank") <= 50) & (F.col("gain") <= -move), "faller"), F.when(mine & (F.col("rank") <= 5), "highlight")
    )
    return rows.withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select("kind", "category_id", "asin", "brand", "rank", "gain")


def siblings(rows: DataFrame, group: str, member: str) -> DataFrame:
    """All ordered pairs of different members of a group; groups are small by their
    meaning (brands of one owner)."""
    a, b = rows.select(group, F.col(member).alias("a")).distinct(), rows.select(F.col(group).alias("_g"), F.col(member).alias("b")).distinct()
    return a.join(b, (F.col(group) == F.col("_g")) & (F.col("a") != F.col("b"))).select(group, "a", "b")


def with_mapping(rows: DataFrame, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` from the mapping where it has the key, else the row's own. Spark
    broadcasts the mapping if its size allows."""
    new = mapping.select(key, F.col(value).alias("_new"))
    return rows.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def contained(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Entities of the listed aliases that a text contains, each once, in order of
    the list. The list is a parameter, so the test is one expression a row."""
    low = F.lower(text)
    found = F.array(*(F.when(F.contains(low, F.lit(a.lower())), F.lit(e)) for a, e in aliases))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def cluster_of(tag: Column, clusters: list[tuple[str, list[str]]]) -> Column:
    """First cluster with a word that the tag contains or that contains it."""
    out = F.lit(None).cast("string")
    for name, words in reversed(clusters):
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(F.lower(tag), F.lit(w)) | F.contains(F.lit(w), F.lower(tag))
        out = F.when(hit, name).otherwise(out)
    return out


def keyword_frequency(docs: DataFrame, words: dict[str, str], text: str = "text") -> DataFrame:
    """In how many texts each keyword occurs, with its class."""
    named = [(w, w) for w in words]
    kind = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    return docs.select(F.explode(contained(F.col(text), named)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("texts")).withColumn("kind", kind[F.col("keyword")])


def trade_summary(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """The k largest groups with their share of all rows."""
    total = F.broadcast(rows.agg(F.count("*").alias("total")))
    return rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(k).join(total, how="cross").withColumn("share", F.col("n") / F.col("total"))


def discount_dependency(shelf: DataFrame) -> DataFrame:
    """Per product: share (percent) of steps with a larger discount and a better rank."""
    order = Window.partitionBy("category_id", "asin").orderBy(DATE)
    both = (F.coalesce("discount_percent", F.lit(0.0)) > F.lag(F.coalesce("discount_percent", F.lit(0.0))).over(order)) & (F.coalesce("rank", F.lit(MISSING)) < F.lag(F.coalesce("rank", F.lit(MISSING))).over(order))
    return shelf.withColumn("_both", F.coalesce(both, F.lit(False))).groupBy("category_id", "asin").agg(
        F.when(F.count("*") > 1, F.round(100 * F.count_if("_both") / (F.count("*") - 1), 1)).otherwise(0.0).alias("score"), F.count("*").alias("seen")
    )


def premium_defense(price: Column, mean: Column, rank: Column) -> Column:
    """90, 70 or 40 by rank above 120 % of the mean price, 50 below, 0 without a price."""
    premium = 100 * (price - mean) / mean
    known = (price > 0) & (mean > 0)
    return F.when(F.coalesce(known, F.lit(False)), F.when(premium > 20, F.when(rank <= 10, 90).when(rank <= 30, 70).otherwise(40)).otherwise(50)).otherwise(0)


def share_drops(shares: DataFrame, points: float = 0.02) -> DataFrame:
    """Brands whose share fell by ``points`` and more since their row before."""
    order = Window.partitionBy("category_id", "brand").orderBy(DATE)
    return shares.withColumn("drop", F.lag("sos").over(order) - F.col("sos")).where(F.col("drop") >= points - 1e-9).select(DATE, "category_id", "brand", "drop")


def relevance_tier(day: Column, end: Column, structural: Column) -> Column:
    """core within 7 days of the end, background within 30 or for structural topics, else null."""
    off = F.abs(F.datediff(day, end))
    return F.when(off <= 7, "core").when((off <= 30) | structural, "background")


def valid_at(at: Column, since: str = "valid_from", until: str = "valid_to") -> Column:
    """Whether a row holds at a time; both ends count, a missing end is open."""
    return (F.col(since).isNull() | (at >= F.col(since))) & (F.col(until).isNull() | (at <= F.col(until)))


def metadata_filter(spec: dict) -> Column:
    """Condition of a filter: ``{k: v}``, ``{k: {"$in": [...]}}``, ``{"$and": [...]}``, ``{"$or": [...]}``; empty is true."""
    out = F.lit(True)
    for key, value in spec.items():
        if key in ("$and", "$or"):
            part = F.lit(key == "$and")
            for one in value:
                part = part & metadata_filter(one) if key == "$and" else part | metadata_filter(one)
        else:
            part = F.col(key).isin(value["$in"]) if isinstance(value, dict) else F.col(key) == value
        out &= F.coalesce(part, F.lit(False))
    return out


def ladder(history: DataFrame) -> DataFrame:
    """Best row of every product in the latest snapshot with the first signal that
    holds, its action and priority: ranks moved by more than 2, a rating below 4, a
    range above 15 in the last seven rows, a place in the Top 5."""
    best = at_latest(history).withColumn("_n", F.row_number().over(Window.partitionBy("asin").orderBy("rank", "category_id"))).where("_n = 1")
    change = F.coalesce("rank_change", F.lit(0))
    step = lambda s, a, p: F.struct(F.lit(s).alias("signal"), F.lit(a).alias("action"), F.lit(p).alias("priority"))
    first = (
        F.when(change < -2, step("rise", "MONITOR", "P1")).when(change > 2, step("fall", "CHECK", "P1")).when((F.col("rating") > 0) & (F.col("rating") < 4), step("low_rating", "CHECK", "P1"))
        .when(F.col("rank_range") > 15, step("volatile", "DEEP DIVE", "P1")).when(F.col("rank") <= 5, step("top", "MONITOR", "P2")).otherwise(step("steady", "DEEP DIVE", "P2"))
    )
    return best.select("asin", "category_id", "rank", change.alias("change"), first.alias("x")).select("asin", "category_id", "rank", "change", "x.*")


def growth_type(discount: Column, coupon: Column, badges: Column, above: float = 15.0) -> Column:
    """discount_based with a discount above ``above``, a coupon or a deal badge, else organic."""
    return F.when((discount > above) | F.coalesce(coupon != "", F.lit(False)) | F.coalesce(badges.rlike("Deal|Lightning"), F.lit(False)), "discount_based").otherwise("organic")


def matrix(shelf: DataFrame, forced: str, k: int = 10) -> DataFrame:
    """The k brands of most rows (two at least) and the forced one, with their average rank."""
    per = shelf.groupBy("brand").agg(F.count("*").alias("products"), F.avg("rank").alias("avg_rank"))
    top = per.where("products >= 2").orderBy(F.desc("products"), "brand").limit(k)
    return top.unionByName(per.where(F.col("brand") == forced)).distinct()


def run_summary(shelf: DataFrame, alerts: DataFrame, mine: Column) -> DataFrame:
    """Per category of the latest snapshot: the target's share, its best product,
    and the snapshot's alerts by severity (alerts: DATE, category_id, severity)."""
    per = at_latest(shelf).groupBy(DATE, "category_id").agg((F.count_if(mine) / F.count("*")).alias("sos"), F.min_by(F.when(mine, F.col("asin")), F.when(mine, F.col("rank"))).alias("best"))
    counts = alerts.groupBy(DATE, "category_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")))
    return per.join(counts, [DATE, "category_id"], "left").na.fill(0, ["critical", "warning", "info"])


def morning_figures(shelf: DataFrame, mine: Column) -> DataFrame:
    """One row of the latest snapshot: the target's products, average rank, number in
    the Top 10, share in percent, and by how much the average rank improved since the snapshot before."""
    daily = shelf.groupBy(DATE).agg(F.count_if(mine).alias("products"), F.avg(F.when(mine, F.col("rank"))).alias("avg_rank"), F.count_if(mine & (F.col("rank") <= 10)).alias("top10"), (100 * F.count_if(mine) / F.count("*")).alias("sos"))
    last = daily.orderBy(F.desc(DATE)).limit(2).agg(F.max_by(F.struct("products", "avg_rank", "top10", "sos"), DATE).alias("v"), F.min_by("avg_rank", DATE).alias("_before"), F.count("*").alias("_n"))
    return last.select("v.*", F.when(F.col("_n") == 2, F.col("_before") - F.col("v.avg_rank")).alias("rank_change"))


def newcomers(shelf: DataFrame, mine: Column, known: int = 50) -> DataFrame:
    """Per category of the latest snapshot: the target's products, all products, and
    how many others there are beyond ``known``."""
    per = at_latest(shelf).groupBy("category_id").agg(F.count_if(mine).alias("own"), F.count("*").alias("products"))
    return per.withColumn("new_competitors", F.greatest(F.lit(0), F.col("products") - F.col("own") - known))


def of_reports(reports: DataFrame, part: str, field: str, wanted: str, keys: list[str], **only) -> DataFrame:
    """Entries of a nested part (array of structs) whose ``field`` is ``wanted``,
    whatever its case, with the report's ``keys``; ``only`` picks reports by their
    columns before anything is unfolded, and other entries are left out inside the row."""
    for name, value in only.items():
        reports = reports.where(F.col(name) == value)
    mine = F.filter(part, lambda x: F.lower(x[field]) == wanted.lower())
    return reports.select(*keys, F.explode(mine).alias("x")).select(*keys, "x.*")


def report_events(reports: DataFrame, part: str, words: list[str], keys: list[str]) -> DataFrame:
    """``(keys, event)``: events of a nested list of texts that contain one of the words, whatever the case."""
    mine = F.filter(part, lambda x: F.exists(F.array(*(F.lit(w.lower()) for w in words)), lambda w: F.contains(F.lower(x), w)))
    return reports.select(*keys, F.explode(mine).alias("event"))
