"""Rule inference: rules are data (name, group, condition, priority, confidence),
conditions are SQL text over one row of metrics per entity.

All rules are tested in one projection: an array of hits is built per row and
exploded, so n rules cost one pass and no union. A null metric makes a condition
false, except where the defaults below stand in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a missing metric counts as.
DEFAULTS = {"sos": 0.0, "cpi": 100.0, "current_rank": 100}

#: Fixed words of the sentiment rules: tags of good value, and words of a summary.
VALUE = ("value for money", "good value", "affordable")
PRAISE = "love|great|excellent|amazing|best|recommend|perfect"
MILD, DOUBT = "like|good|nice", "but|however|although|wish|could be better"

#: (name, group, condition, priority, confidence)
RULES = (
    ("market_dominance_fragmented", "market", "sos >= 0.15 AND hhi < 0.15", 10, 0.9),
    ("market_dominance_concentrated", "market", "sos >= 0.20 AND hhi >= 0.25", 10, 0.9),
    ("challenger_position", "market", "hhi >= 0.25 AND sos >= 0.05 AND sos < 0.15", 8, 0.85),
    ("fragmented_market_competition", "market", "hhi < 0.15 AND competitors >= 5", 7, 0.85),
    ("strong_avg_rank", "market", "avg_rank < 20 AND is_target", 6, 0.85),
    ("competitive_pressure", "market", "sos_change < -0.02 AND competitors >= 3", 8, 0.75),
    ("price_quality_mismatch", "alert", "cpi > 110 AND rating_gap < 0", 9, 0.85),
    ("market_disruption", "alert", "rank_shock AND churn_rate > 0.2", 9, 0.8),
    ("rank_decline_alert", "alert", "rank_change_7 > 0 AND volatility > 5", 8, 0.8),
    ("stable_growth", "growth", "streak >= 30 AND rank_change_7 < 0", 7, 0.9),
    ("trend_alignment_opportunity", "growth", "trend_keywords >= 2 AND is_target", 7, 0.75),
    ("top10_stability", "growth", "current_rank <= 10 AND streak >= 14 AND volatility < 3", 6, 0.9),
    ("category_entry_opportunity", "growth", "hhi < 0.15 AND sos < 0.03 AND is_target", 6, 0.7),
    ("rating_momentum_positive", "growth", "rating_trend > 0.05 AND reviews > 100", 5, 0.8),
    ("top3_achievement", "growth", "current_rank <= 3 AND is_target", 9, 0.95),
    ("strong_rating_position", "growth", "rating_gap > 0.05 AND is_target", 6, 0.85),
    ("value_position", "price", "cpi < 90 AND rating_gap > 0", 6, 0.85),
    ("premium_price_position", "price", "cpi > 150 AND rating_gap >= 0", 7, 0.85),
    ("discount_dependent", "price", "discount_overlap >= 0.8", 8, 0.85),
    ("viral_effect", "price", "abs(price_change) < 0.05 AND rank_change_7 < 0", 8, 0.8),
    ("bestseller_badge_effect", "price", "has_badge AND abs(rank_change_7) <= 3", 7, 0.9),
    ("high_discount_dependency_score", "price", "discount_score >= 0.7", 7, 0.85),
    ("premium_defense_success", "price", "cpi > 120 AND current_rank <= 10", 8, 0.9),
    ("hydration_strength", "sentiment", "size(clusters['Hydration']) >= 2", 7, 0.85),
    ("value_advantage", "sentiment", f"exists(tags, t -> lower(t) IN {VALUE + ('worth the price',)}) AND NOT coalesce(exists(rival_tags, t -> lower(t) IN {VALUE}), false)", 8, 0.8),
    ("packaging_weakness", "sentiment", "NOT coalesce(map_contains_key(clusters, 'Packaging'), false) AND map_contains_key(rival_clusters, 'Packaging')", 6, 0.75),
    ("usability_strength", "sentiment", "map_contains_key(clusters, 'Usability')", 6, 0.8),
    ("effectiveness_strong", "sentiment", "size(clusters['Effectiveness']) >= 1", 7, 0.85),
    ("sensory_gap", "sentiment", "NOT coalesce(map_contains_key(clusters, 'Sensory'), false) AND map_contains_key(rival_clusters, 'Sensory')", 6, 0.75),
    ("perception_positive", "sentiment", f"lower(summary) RLIKE '{PRAISE}'", 7, 0.8),
    ("perception_mixed", "sentiment", f"lower(summary) RLIKE '{MILD}' AND lower(summary) RLIKE '{DOUBT}'", 6, 0.75),
    ("prime_day_impact", "ir", "event_named AND event_rank_change < -10", 9, 0.85),
    ("americas_revenue_correlation", "ir", "revenue_yoy > 0 AND sos_change > 0 AND is_target", 8, 0.8),
    ("growth_momentum", "ir", "growth_quarters >= 2", 7, 0.7),
    ("growth_slowdown_warning", "ir", "growth_before > 0 AND coalesce(growth_now, 0) < growth_before * 0.5", 8, 0.65),
    ("brand_campaign_effect", "ir", "has_campaign AND rank_change_7 < 0", 7, 0.75),
    ("brand_ownership_verification", "ir", "is_owned", 5, 1.0),
)
_OPTIONAL = {
    "double": "sos hhi avg_rank sos_change cpi rating_gap churn_rate rating_trend discount_overlap price_change discount_score volatility revenue_yoy growth_now growth_before",
    "long": "competitors current_rank rank_change rank_change_7 streak trend_keywords reviews growth_quarters event_rank_change", "boolean": "is_target rank_shock has_badge has_campaign is_owned event_named",
    "array<string>": "tags rival_tags", "map<string,array<string>>": "clusters rival_clusters", "string": "summary",
}


def infer(context: DataFrame, keys: list[str], k: int | None = None, rules=RULES) -> DataFrame:
    """Hits (keys, rule, kind, priority, confidence) of a single forward pass; the
    k most important per entity if given. Metrics that the context lacks are null."""
    for kind, names in _OPTIONAL.items():
        missing = [n for n in names.split() if n not in context.columns]
        context = context.withColumns({n: F.lit(None).cast(kind) for n in missing})
    context = context.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in DEFAULTS.items()})
    hit = lambda r: F.when(F.expr(r[2]), F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("kind"), F.lit(r[3]).alias("priority"), F.lit(r[4]).alias("confidence")))
    hits = F.filter(F.array(*map(hit, rules)), lambda h: h.isNotNull())
    out = context.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")
    if k is not None:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority"), "rule"))
        out = out.withColumn("place", place).where(F.col("place") <= k).drop("place")
    return out


def merge_insights(insights: DataFrame, keys: list[str]) -> DataFrame:
    """Merge by the first 50 characters, lower case: the first confidence, then half
    of each duplicate's, capped at 1 after every step in the given order."""
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("ordinal", "confidence"))), F.lit(0.0), lambda acc, x: F.when(acc == 0, x["confidence"]).otherwise(F.least(F.lit(1.0), acc + x["confidence"] / 2)))
    return insights.groupBy(*keys, F.lower(F.substring("text", 1, 50)).alias("insight")).agg(folded.alias("confidence"), F.count("*").alias("sources"))


def thresholds(metrics: DataFrame, table: DataFrame) -> DataFrame:
    """Declarative rules (metric, op, limit, severity) joined with long-form metrics; an unknown operator is false."""
    v, t = F.col("value"), F.col("limit")
    holds = F.when(F.col("op") == ">=", v >= t).when(F.col("op") == ">", v > t).when(F.col("op") == "<=", v <= t).when(F.col("op") == "<", v < t).when(F.col("op") == "==", v == t).when(F.col("op") == "!=", v != t).otherwise(False)
    return metrics.join(F.broadcast(table), "metric").where(holds)


def top_actions(context: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """Rule hits and alerts of an entity as one list of actions, by priority and
    then name, ``k`` at most: (keys, origin, name, priority)."""
    hits = infer(context, keys).select(*keys, F.lit("rule").alias("origin"), F.col("rule").alias("name"), "priority")
    alerts = context.where("rank_shock").select(*keys, F.lit("alert").alias("origin"), F.lit("rank_shock").alias("name"), F.lit(9).alias("priority"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority"), "name"))
    return hits.unionByName(alerts).withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def action_queue(context: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Up to ``most`` actions (keys, place, action) for rows with shocks, cpi,
    rating_gap and churn_rate, in a fixed order; all_quiet if none is due."""
    due = F.array(
        F.when(F.col("shocks") > 0, F.lit("check_moved_products")), F.when((F.col("cpi") > 100) & (F.col("rating_gap") < 0), F.lit("check_price_against_rating")),
        F.when(F.col("churn_rate") > 0.2, F.lit("check_entries_and_exits")),
    )
    named = F.filter(due, lambda x: x.isNotNull())
    return context.select(*keys, F.posexplode(F.when(F.size(named) == 0, F.array(F.lit("all_quiet"))).otherwise(F.slice(named, 1, most))).alias("place", "action"))
