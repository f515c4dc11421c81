"""Evaluation of ranked and set-valued answers with array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean(a: Column) -> Column:
    return F.array_distinct(F.transform(a, lambda x: F.lower(F.trim(x))))


def set_f1(found: Column, gold: Column) -> Column:
    """Both empty 1, one empty 0."""
    both = F.size(F.array_intersect(clean(found), clean(gold)))
    total = F.size(clean(found)) + F.size(clean(gold))
    return F.when(total == 0, 1.0).otherwise(2.0 * both / total)


def recall_at(found: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(found, 1, k), gold)) / F.size(gold))


def precision_at(found: Column, gold: Column, k: int) -> Column:
    """Divides by what was retrieved, not by k; duplicates count."""
    cut = F.slice(found, 1, k)
    return F.when(F.size(cut) == 0, 0.0).otherwise(F.size(F.filter(cut, lambda x: F.array_contains(gold, x))) / F.size(cut))


def reciprocal_rank(found: Column, gold: Column) -> Column:
    places = F.filter(F.transform(gold, lambda g: F.array_position(found, g)), lambda p: p > 0)
    return F.coalesce(1.0 / F.array_min(places), F.lit(0.0))


def hits_at(found: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) == 0, 1.0).otherwise(F.arrays_overlap(F.slice(found, 1, k), gold).cast("double"))


def ndcg_at(found: Column, gold: Column, k: int, mode: str = "standard") -> Column:
    """Binary nDCG. ``standard``: the ideal ranks all gold first; ``retrieved``:
    only gold that was retrieved counts in the ideal."""
    gain = lambda a: F.aggregate(F.transform(a, lambda rel, i: rel / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x)
    rel = F.transform(F.slice(found, 1, k), lambda x: F.array_contains(gold, x).cast("double"))
    n = F.size(gold) if mode == "standard" else F.size(F.array_intersect(found, gold))
    ideal = gain(F.transform(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1))), lambda i: F.lit(1.0)))
    return F.when(n == 0, 0.0).otherwise(gain(rel) / ideal)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def ranked(found: DataFrame, key: str, k: int = 10, hits: int = 3) -> DataFrame:
    """All of the measures above from rows (key, rank, right, gold): whether the
    item at that rank is gold, and how many gold items the key has. Gold of any
    size is a number here and never a list."""
    right = F.col("right") & (F.col("rank") <= k)
    per = found.groupBy(key).agg(
        F.max("gold").alias("gold"), F.count_if(F.col("rank") <= k).alias("found"), F.count_if(right).alias("both"), F.min(F.when(right, F.col("rank"))).alias("first"),
        F.sum(F.when(right, 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias("gain"),
    )
    ideals = F.array(*(F.lit(sum(1 / math.log2(i + 2) for i in range(n + 1))) for n in range(k)))
    ideal = lambda n: F.element_at(ideals, F.least(n, F.lit(k)).cast("int"))
    none, gold, found_n, both = F.col("gold") == 0, F.col("gold"), F.col("found"), F.col("both")
    return per.select(
        key, F.when(none, 1.0).otherwise(both / gold).alias("recall"), F.when(found_n == 0, 0.0).otherwise(both / found_n).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(none, 1.0).otherwise(F.coalesce(F.col("first") <= hits, F.lit(False)).cast("double")).alias("hits"),
        F.when(both == 0, 0.0).otherwise(F.col("gain") / ideal(F.greatest(gold, F.lit(1)))).alias("standard"), F.when(both == 0, 0.0).otherwise(F.col("gain") / ideal(F.greatest(both, F.lit(1)))).alias("retrieved"),
        F.when(found_n + gold == 0, 1.0).otherwise(2.0 * both / (found_n + gold)).alias("f1"), F.when(found_n + gold == 0, 1.0).otherwise(both / (found_n + gold - both)).alias("jaccard"),
    )


def overall(layers: dict[str, Column], graph: Column, answer: list[Column]) -> Column:
    """Overall score of an item: 0.45 answer, 0.35 retrieval, 0.10 mapping, 0.10 ontology.

    ``layers`` holds entity_link_f1, concept_map_f1, constraint_f1, recall, precision,
    mrr, hits, edge_f1, violation_rate and type_consistency; items that need the
    ``graph`` weigh retrieval otherwise. ``answer`` scores that are null don't count.
    """
    x = layers
    mapping = (x["entity_link_f1"] + x["concept_map_f1"] + x["constraint_f1"]) / 3
    with_graph = 0.3 * x["recall"] + 0.1 * x["mrr"] + 0.4 * x["hits"] + 0.2 * x["edge_f1"]
    without = 0.5 * x["recall"] + 0.2 * x["precision"] + 0.3 * x["mrr"]
    ontology = 0.5 * (1 - x["violation_rate"]) + 0.5 * x["type_consistency"]
    given = F.filter(F.array(*answer), lambda v: v.isNotNull())
    said = F.when(F.size(given) == 0, 0.0).otherwise(F.aggregate(given, F.lit(0.0), lambda a, v: a + v) / F.size(given))
    return 0.45 * said + 0.35 * F.when(graph, with_graph).otherwise(without) + 0.10 * mapping + 0.10 * ontology


def graph_layer(found: Column, gold: Column, found_edges: Column, gold_edges: Column, k: int = 10) -> Column:
    """struct(hits, edge_f1, precision, recall) of the entities and edges found in a graph."""
    return F.struct(
        hits_at(found, gold, k).alias("hits"), set_f1(found_edges, gold_edges).alias("edge_f1"), set_precision(found, gold).alias("precision"), set_recall(found, gold).alias("recall")
    )


def graded_ndcg(ranked_rows: DataFrame, key: str, k: int = 10) -> DataFrame:
    """nDCG with graded gains from rows (key, rank, gain); the ideal sorts all gains
    of the key, also of rows beyond ``k`` (rank null: not found). 0 without any gain."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("gain")))
    rows = ranked_rows.withColumn("_best", best)
    gained = lambda place: F.sum(F.when(F.col(place) <= k, F.col("gain") / F.log2(F.col(place) + F.lit(1.0))).otherwise(0.0))
    return rows.groupBy(key).agg(gained("rank").alias("_dcg"), gained("_best").alias("_ideal")).select(key, F.when(F.col("_ideal") > 0, F.col("_dcg") / F.col("_ideal")).otherwise(0.0).alias("ndcg"))


def report(results: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """Means per dimension and overall in one grouping-sets pass."""
    return results.rollup(*dims).agg(*(F.avg(m).alias(m) for m in metrics), F.count("*").alias("items"))


def compare(base: DataFrame, now: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 0.05) -> DataFrame:
    """Metric by metric change against a baseline, with severity."""
    flat = lambda d, v: d.unpivot(keys, metrics, "metric", v)
    joined = flat(base, "before").join(flat(now, "after"), [*keys, "metric"])
    drop = F.col("before") - F.col("after")
    return joined.withColumn("severity", F.when(drop > 3 * tolerance, "critical").when(drop > tolerance, "warning").when(drop < -tolerance, "better").otherwise("same"))


def histogram(samples: DataFrame, key: str, value: str, order: list[str], keep: int = 1000) -> DataFrame:
    """Quantiles of the last ``keep`` samples by index into their sorted values:
    n // 2, int(0.9 n), int(0.99 n)."""
    newest = Window.partitionBy(key).orderBy(*map(F.desc, order))
    last = samples.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= keep)
    pick = lambda q: F.element_at("v", F.floor(F.size("v") * q).cast("int") + 1)
    return last.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("v")).select(key, F.size("v").cast("long").alias("n"), pick(0.5).alias("p50"), pick(0.9).alias("p90"), pick(0.99).alias("p99"))


def set_precision(found: Column, gold: Column) -> Column:
    """Nothing found is 1 if nothing was wanted, else 0."""
    n = F.size(clean(found))
    return F.when(n == 0, (F.size(clean(gold)) == 0).cast("double")).otherwise(F.size(F.array_intersect(clean(found), clean(gold))) / n)


def set_recall(found: Column, gold: Column) -> Column:
    """Nothing wanted is 1."""
    n = F.size(clean(gold))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(clean(found), clean(gold))) / n)


def answer_words(c: Column) -> Column:
    """Distinct lower-case words without punctuation."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+"), lambda x: x != ""))


def exact_match(answer: Column, gold: Column) -> Column:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))
    return (plain(answer) == plain(gold)).cast("double")


def token_f1(answer: Column, gold: Column) -> Column:
    """F1 over the sets of words; no gold is 1."""
    return F.when(gold.isNull() | (gold == ""), 1.0).otherwise(set_f1(answer_words(answer), answer_words(gold)))


def numeric_accuracy(answer: Column, wanted: Column, tolerance: float = 0.05) -> Column:
    """Share of the wanted numbers that a number of the answer meets within the relative tolerance; 1 without any."""
    said = F.transform(F.regexp_extract_all(answer, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    met = F.filter(wanted, lambda w: F.exists(said, lambda s: F.abs(s - w) <= tolerance * F.abs(w)))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(met) / F.size(wanted))


#: How figures are named in answers, in the order in which they are read, fixed values.
KPI_PATTERNS = (
    r"(?:sos|share\s+of\s+shelf|점유율)[:\s]*(\d+(?:\.\d+)?)\s*%?", r"(?:hhi|허핀달|시장집중도)[:\s]*(\d+(?:\.\d+)?)", r"(?:cpi|가격지수|price\s+index)[:\s]*(\d+(?:\.\d+)?)",
    r"(?:churn|교체율|이탈율)[:\s]*(\d+(?:\.\d+)?)\s*%?", r"(?:growth|성장률|증가율)[:\s]*(-?\d+(?:\.\d+)?)\s*%?", r"(?:rank|순위)[:\s]*#?(\d+)",
)
#: Names of categories, and categories that exclude each other in an answer, fixed values.
CATEGORY_NAMES = {
    "lip care": "lip_care", "립케어": "lip_care", "립 케어": "lip_care", "lip makeup": "lip_makeup", "립메이크업": "lip_makeup", "립 메이크업": "lip_makeup",
    "skin care": "skin_care", "스킨케어": "skin_care", "스킨 케어": "skin_care", "face powder": "face_powder", "파우더": "face_powder", "페이스파우더": "face_powder", "beauty": "beauty", "뷰티": "beauty",
}
CONFUSED = (("lip_care", "lip_makeup"), ("skin_care", "makeup"))


def figures_said(text: Column, patterns: tuple[str, ...] = KPI_PATTERNS) -> Column:
    """Numbers of a text: those that a pattern names, by pattern, then place; without any, every number. Repeats stay; null has none."""
    numbers = lambda c, p, group: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(group)), lambda x: x.cast("double"))
    named = F.concat(*(numbers(F.lower(text), p, 1) for p in patterns))
    return F.when(F.size(named) > 0, named).otherwise(numbers(text, r"-?\d+(?:\.\d+)?", 0))


def figures_met(answer: Column, gold: Column, tolerance: float = 0.05) -> Column:
    """Share of the gold text's figures that some figure of the answer meets within
    the tolerance, relative to the gold's (below 0.001: within 0.001); 1 without any."""
    said, wanted = figures_said(answer), figures_said(gold)
    close = lambda a, b: (a == b) | F.when(F.abs(b) < 0.001, F.abs(a - b) < 0.001).otherwise(F.abs(a - b) / F.abs(b) <= tolerance)
    met = F.filter(wanted, lambda w: F.exists(said, lambda a: close(a, w)))
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(met) / F.size(wanted))


def category_met(answer: Column, gold: Column, names: dict[str, str] = CATEGORY_NAMES, confused: tuple[tuple[str, ...], ...] = CONFUSED) -> Column:
    """1 if the answer names the gold category as whole words and none that is
    confused with it, else 0; the gold may be any of its names, in any case."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    kinds = sorted(set(names.values()))
    said = {k: F.rlike(low, F.lit(r"(?U)\b(?:" + "|".join(rf"\Q{a}\E" for a, c in names.items() if c == k) + r")\b")) for k in kinds}
    wanted = F.lower(F.trim(gold))
    wanted = F.coalesce(F.create_map(*(F.lit(x) for p in names.items() for x in p))[wanted], wanted)
    right = F.lit(False)
    for k in kinds:
        others = [said[o] for group in confused if k in group for o in group if o != k and o in said]
        fine = said[k]
        for other in others:
            fine = fine & ~other
        right = F.when(wanted == k, fine).otherwise(right)
    return right.cast("double")


def violation_rate(violations: Column, inferences: Column, explicit: Column) -> Column:
    return violations / (inferences + F.greatest(F.lit(1), explicit))


def stub_judge(answer: Column, context: Column) -> Column:
    """0.3 and 0.4 of the share of the answer's words that the context has."""
    said = answer_words(answer)
    return 0.3 + 0.4 * F.when(F.size(said) == 0, 0.0).otherwise(F.size(F.array_intersect(said, answer_words(context))) / F.size(said))


#: Limits of the gate, fixed values: (tag, metric, limit, whether the metric must be at least it, for items with a graph, without, or any).
GATES = (
    ("L1_mapping_fail", "entity_link_f1", 0.5, True, None), ("L1_concept_fail", "concept_map_f1", 0.5, True, None), ("L2_doc_retrieval_fail", "context_recall", 0.8, True, False),
    ("L3_kg_fail", "hits", 0.8, True, True), ("L3_edge_fail", "edge_f1", 0.5, True, True), ("L4_constraint_violation", "violation_rate", 0.05, False, None),
    ("L4_type_inconsistency", "type_consistency", 0.9, True, None), ("L5_wrong_answer", "answer_f1", 0.5, True, None), ("L5_grounding_fail", "groundedness", 0.7, True, None),
    ("L5_relevance_fail", "relevance", 0.7, True, None),
)


def fail_tags(items: DataFrame, requires_graph: Column, gates=GATES) -> Column:
    """Tags of the gates that an item fails; a metric that is null or absent fails none."""
    tags = []
    for tag, metric, limit, least, graph in gates:
        if metric in items.columns:
            fails = F.col(metric) < limit if least else F.col(metric) > limit
            tags.append(F.when(fails if graph is None else fails & (requires_graph if graph else ~requires_graph), F.lit(tag)))
    return F.filter(F.array(*tags), lambda x: x.isNotNull())


def costs(calls: DataFrame, prices: dict[str, float], layer: str, model: str, tokens: str) -> DataFrame:
    """Cost of each layer from the price of a thousand tokens of every model; models without a price are counted apart."""
    price = F.create_map(*(F.lit(x) for pair in prices.items() for x in pair))[F.col(model)]
    return calls.groupBy(layer).agg((F.sum(F.col(tokens) * price) / 1000).alias("cost"), F.sum(tokens).alias("tokens"), F.count_if(price.isNull()).alias("unpriced"))


def last_figures(samples: DataFrame, key: str, order: list[str], value: str, keep: int = 100) -> DataFrame:
    """Count, mean and least of the newest ``keep`` samples of a key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*map(F.desc, order)))
    return samples.withColumn("_n", place).where(F.col("_n") <= keep).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"))
