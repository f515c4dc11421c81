"""Queries over tables that are stored and changed, and over traces of runs, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfloom.operators import claims as C
from shelfloom.operators import dashboard as D
from shelfloom.operators import evaluation as E
from shelfloom.operators import graph as G
from shelfloom.operators import shelf as S
from shelfloom.sources import files, stored, tables
from shelfloom.sources import views as V
from shelfloom.streaming import suppression
from shelfloom.streaming import windows as W

from . import analytics as A
from . import texts as X

QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql=None, doubles=""):
    """Register a plan over (spark, folder); doubles are rounded to 6 digits on both sides."""
    cols = doubles.split()
    QUERIES[name] = lambda spark, sf: plan(spark, sf).withColumns({c: F.round(F.col(c), 6) for c in cols})
    if sql:
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in cols)}) FROM ({sql})" if cols else sql


def _folder(s, name):
    return f"{tables.shared_folder(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- upserts into stored tables

RANK_KEY = ["snapshot_date", "category_id", "rank"]
METRIC_KEY = ["snapshot_date", "category_id", "brand"]


def _ranks(s, d):
    """Snapshots stored with the list price; the last year's come again with the
    price paid, twice. Each run rewrites the partitions (months) that it changes."""
    folder, shelf = _folder(s, "ranks"), tables.written(V.shelf(s, d).select(*RANK_KEY, "asin", "price", "list_price"))
    runs = [shelf.withColumn("price", F.col("list_price")), shelf.where("snapshot_date >= '1998-01-01'"), shelf.where("snapshot_date >= '1998-01-01'")]
    touched = [stored.upsert(r, folder, RANK_KEY, "snapshot_date") for r in runs]
    rows = s.read.parquet(folder)
    return rows.groupBy("snapshot_date").agg(F.count("*").alias("rows"), F.sum("price").alias("total")).select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "rows", "total", F.lit(touched[0]).cast("long").alias("first_run"), F.lit(touched[1]).cast("long").alias("second_run"), F.lit(touched[2]).cast("long").alias("third_run"))


add("ranks_stored", _ranks, f"""WITH {V.SHELF_SQL} SELECT snapshot_date::VARCHAR AS snapshot_date, count(*) AS rows, sum(CASE WHEN snapshot_date >= DATE '1998-01-01' THEN price ELSE list_price END) AS total,
  (SELECT count(DISTINCT snapshot_date) FROM shelf) AS first_run, (SELECT count(DISTINCT snapshot_date) FROM shelf WHERE snapshot_date >= DATE '1998-01-01') AS second_run, 0::BIGINT AS third_run FROM shelf GROUP BY 1, shelf.snapshot_date""", "total")


def _metrics(s, d):
    """Brand metrics of the first category, then of all: rows of the same key are replaced."""
    folder, m = _folder(s, "metrics"), tables.written(S.share_of_shelf(V.shelf(s, d)).select(*METRIC_KEY, "products", "sos"))
    stored.upsert(m.where("category_id = 'PROMO'").withColumn("sos", F.lit(0.0)), folder, METRIC_KEY, "category_id")
    stored.upsert(m, folder, METRIC_KEY, "category_id")
    return s.read.parquet(folder).groupBy("category_id").agg(F.count("*").alias("rows"), F.sum("sos").alias("shares"))


add("metrics_stored", _metrics, f"WITH {V.SHELF_SQL} SELECT category_id, count(*) AS rows, sum(sos) AS shares FROM (SELECT snapshot_date, category_id, brand, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY snapshot_date, category_id) AS sos FROM shelf GROUP BY 1, 2, 3) GROUP BY 1", "shares")


# --- versions of the graph


def _as_of(s, d):
    """Two versions and one that was written but never committed."""
    folder, t = _folder(s, "graph"), V.triples(s, d)
    stored.commit(t.where("predicate <> 'originatesFrom'"), folder, "without origins")
    stored.commit(t, folder, "all")
    t.where("predicate = 'hasProduct'").write.parquet(f"{folder}/data/{uuid.uuid4().hex}")
    count = lambda v: stored.as_of(s, folder, v).groupBy("predicate").agg(F.count("*").alias("n")).select(F.lit(v or 2).cast("long").alias("version"), "predicate", "n")
    return count(1).union(count(None))


add("kg_as_of", _as_of, f"WITH {V.TRIPLES_SQL} SELECT v AS version, predicate, count(*) AS n FROM triples, (SELECT unnest([1::BIGINT, 2::BIGINT]) AS v) WHERE v = 2 OR predicate <> 'originatesFrom' GROUP BY 1, 2")


# --- traces: one JSON text a conversation. What its turns say stands for what was linked, inferred and answered.


def traces(s, d):
    """(item, trace) with the trace as VARIANT."""
    c = V.table(s, d, "conversations")
    word = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: F.length(w) > 3)
    turn = F.struct("turn", "role", F.slice(word, 1, 6).alias("words"), F.length("text").alias("size"))
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    of = lambda role: F.array_distinct(F.flatten(F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: x["words"])))
    body = F.to_json(F.struct(
        F.struct(of("assistant").alias("entities")).alias("l1"), F.struct(F.transform("t", lambda x: F.struct(x["size"].alias("size"), (x["size"] > 250).alias("broken"))).alias("inferences")).alias("l4"),
        F.struct(of("user").alias("entities")).alias("gold"), F.struct(F.size("t").alias("turns")).alias("l5"),
    ))
    return per.select(F.col("conv_id").alias("item"), F.parse_json(body).alias("trace"))


def _layers(s, d):
    """Each layer's own columns out of the nested trace."""
    words = lambda path: F.coalesce(F.variant_get("trace", path, "array<string>"), F.array().cast("array<string>"))
    return traces(s, d).select("item", words("$.l1.entities").alias("found"), words("$.gold.entities").alias("gold"), F.variant_get("trace", "$.l4.inferences", "array<struct<size: long, broken: boolean>>").alias("inferences"), F.variant_get("trace", "$.l5.turns", "long").alias("turns"))


def _scores(s, d):
    """Entity F1 of layer 1; of layer 4 the violation rate (an inference checked and
    one explicit check at least) and the share of entities of a known type (here: of six letters at most)."""
    known = F.filter("found", lambda w: F.length(w) <= 6)
    broken = F.size(F.filter("inferences", lambda x: x["broken"]))
    return _layers(s, d).select(
        "item", E.set_f1(F.col("found"), F.col("gold")).alias("entity_f1"), F.when(F.size("inferences") == 0, 0.0).otherwise(F.least(F.lit(1.0), broken / (F.size("inferences") + 1))).alias("violation_rate"),
        F.when(F.size("found") == 0, 1.0).otherwise(F.size(known) / F.size("found")).alias("type_consistency"), "turns",
    )


_W = "list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) > 3)[1:6]"
_OF = "list_distinct(flatten(coalesce(list({w}) FILTER (role = '{r}'), [])))"
_TRACE = f"(SELECT conv_id AS item, {_OF.format(w=_W, r='assistant')} AS found, {_OF.format(w=_W, r='user')} AS gold, count(*) FILTER (length(text) > 250) AS broken, count(*) AS turns FROM conversations GROUP BY 1)"
_SCORES = f"""SELECT item, CASE WHEN len(found) + len(gold) = 0 THEN 1 ELSE 2.0::DOUBLE * len(list_intersect(found, gold)) / (len(found) + len(gold)) END AS entity_f1, least(1, broken::DOUBLE / (turns + 1)) AS violation_rate,
  CASE WHEN len(found) = 0 THEN 1 ELSE len(list_filter(found, lambda w: length(w) <= 6))::DOUBLE / len(found) END AS type_consistency, turns FROM {_TRACE}"""
add("trace_layers", lambda s, d: _layers(s, d).select("item", F.array_join(F.array_sort("found"), ",").alias("found"), F.array_join(F.array_sort("gold"), ",").alias("gold"), F.size("inferences").cast("long").alias("inferences"), "turns"),
    f"SELECT item, array_to_string(list_sort(found), ',') AS found, array_to_string(list_sort(gold), ',') AS gold, turns AS inferences, turns FROM {_TRACE}")
add("trace_scores", _scores, _SCORES, "entity_f1 violation_rate type_consistency")


def _report(s, d):
    """Means and fails of the layers by number of turns, and over all."""
    rows = _scores(s, d)
    fails = [F.count_if(F.col("entity_f1") < 0.5).alias("entity_fails"), F.count_if(F.col("violation_rate") > 0.05).alias("violation_fails"), F.count_if(F.col("type_consistency") < 0.95).alias("type_fails")]
    return rows.rollup("turns").agg(F.count("*").alias("items"), *(F.avg(c).alias(c) for c in ("entity_f1", "violation_rate", "type_consistency")), *fails)


add("trace_report", _report, f"SELECT turns, count(*) AS items, avg(entity_f1) AS entity_f1, avg(violation_rate) AS violation_rate, avg(type_consistency) AS type_consistency, count(*) FILTER (entity_f1 < 0.5) AS entity_fails, count(*) FILTER (violation_rate > 0.05::DOUBLE) AS violation_fails, count(*) FILTER (type_consistency < 0.95::DOUBLE) AS type_fails FROM ({_SCORES}) GROUP BY ROLLUP (turns)", "entity_f1 violation_rate type_consistency")


# --- gates and overall score of traces: words in order of the alphabet stand for a
# ranking, long words for concepts, short ones for constraints, beginnings for edges;
# items of more than two turns need the graph, those of one have no relevance


def _graded(s, d):
    """All layers' metrics of every trace, under the names that gates and score use."""
    part = lambda c, longer: F.filter(c, lambda w: (F.length(w) > 6) == longer)
    heads = lambda c: F.transform(c, lambda w: F.substring(w, 1, 2))
    found, gold = F.col("found"), F.col("gold")
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))
    metrics = {
        "entity_link_f1": E.set_f1(found, gold), "concept_map_f1": E.set_f1(part(found, True), part(gold, True)), "constraint_f1": E.set_f1(part(found, False), part(gold, False)),
        "context_recall": E.recall_at(found, gold, 10), "context_precision": E.precision_at(found, gold, 10), "mrr": E.reciprocal_rank(found, gold), "hits": E.hits_at(found, gold, 10),
        "edge_f1": E.set_f1(heads(found), heads(gold)), "answer_f1": E.set_f1(heads(gold), heads(found)), "groundedness": share(heads(found), heads(gold)), "relevance": F.when(F.col("turns") > 1, share(heads(gold), heads(found))),
    }
    layers = _layers(s, d).withColumn("found", F.array_sort("found")).select("item", *(c.alias(n) for n, c in metrics.items()))
    return layers.join(_scores(s, d).select("item", "violation_rate", "type_consistency", "turns"), "item").withColumn("graph", F.col("turns") > 2)


def _gated(s, d):
    """Overall score, tags of the gates that an item fails, and whether it passes."""
    items = _graded(s, d)
    names = {"recall": "context_recall", "precision": "context_precision"}
    layers = {n: F.col(names.get(n, n)) for n in ("entity_link_f1", "concept_map_f1", "constraint_f1", "recall", "precision", "mrr", "hits", "edge_f1", "violation_rate", "type_consistency")}
    tags = E.fail_tags(items, F.col("graph"))
    return items.select("item", E.overall(layers, F.col("graph"), [F.col("answer_f1"), F.col("groundedness"), F.col("relevance")]).alias("score"), F.array_join(tags, ",").alias("tags"), (F.size(tags) == 0).alias("passed"))


_SET_F1 = "CASE WHEN len({a}) + len({b}) = 0 THEN 1 ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
_LONG = "list_filter({c}, lambda w: length(w) > 6)"
_SHORT = "list_filter({c}, lambda w: length(w) <= 6)"
_HEADS = "list_distinct(list_transform({c}, lambda w: w[1:2]))"


def _two(of):
    return _SET_F1.format(a=of.format(c="found"), b=of.format(c="gold"))


# the limits and weights are written out here once more, so that a wrong one of the library shows
add("trace_gates", _gated, f"""WITH s AS (SELECT item, list_sort(found) AS found, gold, turns, turns > 2 AS graph, {_HEADS.format(c='found')} AS hf, {_HEADS.format(c='gold')} AS hg, least(1, broken::DOUBLE / (turns + 1)) AS violation,
    CASE WHEN len(found) = 0 THEN 1 ELSE len({_SHORT.format(c='found')})::DOUBLE / len(found) END AS typed FROM {_TRACE}),
  m AS (SELECT *, {_two('{c}')} AS entity, {_two(_LONG)} AS concept, {_two(_SHORT)} AS con, CASE WHEN len(gold) = 0 THEN 1 ELSE len(list_intersect(found[:10], gold))::DOUBLE / len(gold) END AS recall,
    CASE WHEN len(found) = 0 THEN 0 ELSE len(list_intersect(found[:10], gold))::DOUBLE / len(found[:10]) END AS prec, coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(gold, lambda g: list_position(found, g)), lambda p: p > 0)), 0) AS mrr,
    CASE WHEN len(gold) = 0 THEN 1 ELSE list_has_any(found[:10], gold)::INT END AS hit, {_SET_F1.format(a='hf', b='hg')} AS edge FROM s),
  n AS (SELECT *, CASE WHEN len(found) > 0 THEN len(list_intersect(hf, hg))::DOUBLE / len(found) END AS ground, CASE WHEN turns > 1 AND len(gold) > 0 THEN len(list_intersect(hf, hg))::DOUBLE / len(gold) END AS rel FROM m),
  o AS (SELECT item, 0.45::DOUBLE * (edge + coalesce(ground, 0) + coalesce(rel, 0)) / (1 + (ground IS NOT NULL)::INT + (rel IS NOT NULL)::INT)
      + 0.35::DOUBLE * CASE WHEN graph THEN 0.3::DOUBLE * recall + 0.1::DOUBLE * mrr + 0.4::DOUBLE * hit + 0.2::DOUBLE * edge ELSE 0.5::DOUBLE * recall + 0.2::DOUBLE * prec + 0.3::DOUBLE * mrr END
      + 0.1::DOUBLE * (entity + concept + con) / 3 + 0.1::DOUBLE * (0.5::DOUBLE * (1 - violation) + 0.5::DOUBLE * typed) AS score,
    concat_ws(',', CASE WHEN entity < 0.5::DOUBLE THEN 'L1_mapping_fail' END, CASE WHEN concept < 0.5::DOUBLE THEN 'L1_concept_fail' END, CASE WHEN NOT graph AND recall < 0.8::DOUBLE THEN 'L2_doc_retrieval_fail' END, CASE WHEN graph AND hit < 0.8::DOUBLE THEN 'L3_kg_fail' END,
      CASE WHEN graph AND edge < 0.5::DOUBLE THEN 'L3_edge_fail' END, CASE WHEN violation > 0.05::DOUBLE THEN 'L4_constraint_violation' END, CASE WHEN typed < 0.9::DOUBLE THEN 'L4_type_inconsistency' END, CASE WHEN edge < 0.5::DOUBLE THEN 'L5_wrong_answer' END,
      CASE WHEN ground < 0.7::DOUBLE THEN 'L5_grounding_fail' END, CASE WHEN rel < 0.7::DOUBLE THEN 'L5_relevance_fail' END) AS tags FROM n)
  SELECT item, score, tags, tags = '' AS passed FROM o""", "score")


# --- answers judged by their figures and categories


def _said(s, d):
    """Leading brand's share, concentration and number of products of every month and
    category, as an answer by names of last month's and as a gold text of this
    month's; a third of both has bare numbers."""
    per = V.shelf(s, d).groupBy("snapshot_date", "category_id", "brand").agg(F.count("*").alias("n"))
    m = per.groupBy("snapshot_date", "category_id").agg(F.sum("n").alias("t"), F.max("n").alias("top"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    m = m.select("snapshot_date", "category_id", F.expr("top * 1000 div t").alias("sos"), F.expr("squares * 10000 div (t * t)").alias("hhi"), "t")
    share = F.concat(F.expr("sos div 10").cast("string"), F.lit("."), F.expr("sos % 10").cast("string"))
    bare = F.month("snapshot_date") % 3 == 0
    texts = m.withColumns({
        "said": F.when(bare, F.concat_ws(" and ", share, "hhi", "t")).otherwise(F.concat(F.lit("In 2 parts: Share of shelf: "), share, F.lit("%, HHI "), "hhi", F.lit("; rank #"), "t")),
        "gold": F.when(bare, F.concat_ws("; ", share, "hhi", "t")).otherwise(F.concat(F.lit("1위: 점유율 "), share, F.lit(" %, 시장집중도: "), "hhi", F.lit(", 순위 "), "t")),
    })
    return texts.withColumn("said", F.lag("said").over(Window.partitionBy("category_id").orderBy("snapshot_date")))


add("figures_met", lambda s, d: _said(s, d).select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "category_id", E.figures_met(F.col("said"), F.col("gold")).alias("met")), f"""WITH {V.SHELF_SQL},
  m AS (SELECT snapshot_date, category_id, [max(n) * 1000 // sum(n) / 10.0::DOUBLE, sum(n * n) * 10000 // (sum(n) * sum(n)), sum(n)]::DOUBLE[] AS v FROM (SELECT snapshot_date, category_id, brand, count(*) AS n FROM shelf GROUP BY 1, 2, 3) GROUP BY 1, 2),
  w AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY category_id ORDER BY snapshot_date), []) AS b FROM m)
  SELECT snapshot_date::VARCHAR AS snapshot_date, category_id, len(list_filter(v, lambda x: len(list_filter(b, lambda y: x = y OR abs(y - x) / abs(x) <= 0.05::DOUBLE)) > 0)) / 3.0::DOUBLE AS met FROM w""", "met")

KINDS = {"economy": "eco", "standard": "std", "promo": "promo", "small": "small", "medium": "medium", "large": "large"}
EXCLUDED = (("eco", "std"), ("promo", "small", "medium"))


def _kinds_said(s, d):
    """Orders as answers that name the kinds of their products; the gold is the first product's kind, by one of its names."""
    sold = V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(V.table(s, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    per = sold.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("kinds"), F.min_by("p_type", F.struct("l_linenumber", "l_partkey")).alias("gold"))
    return per.select("l_orderkey", F.concat(F.lit("Goods: "), F.array_join("kinds", ", "), F.lit(", smallish.")).alias("said"), F.concat(F.lit(" "), "gold").alias("gold"))


_EXCLUDED = " OR ".join(f"(gold IN {g} AND len(list_filter(kinds, lambda k: k IN {g} AND k <> gold)) > 0)" for g in (tuple(n.upper() for n, k in KINDS.items() if k in group) for group in EXCLUDED))
add("categories_met", lambda s, d: _kinds_said(s, d).select("l_orderkey", E.category_met(F.col("said"), F.col("gold"), KINDS, EXCLUDED).alias("met")),
    f"SELECT l_orderkey, (NOT ({_EXCLUDED}))::INT::DOUBLE AS met FROM (SELECT l_orderkey, list(DISTINCT p_type) AS kinds, arg_min(p_type, (l_linenumber, l_partkey)) AS gold FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)")


# --- values, alerts, freshness and nested reports


def _entities(s, d):
    """Brands with all positions of the last month, their largest share (percents and
    blanks in some sources) and mean rank, as texts."""
    last = V.latest_shelf(s, d)
    m = S.share_of_shelf(last).select("category_id", "brand", "sos")
    positions = G.market_position(m).groupBy("brand").agg(F.collect_set("position").alias("classes"), F.max("sos").alias("sos"))
    rank = last.groupBy("brand").agg((F.sum("rank") / F.count("*")).alias("rank"))
    n = F.regexp_extract("brand", "([0-9]+)", 1).cast("int")
    share = F.when(n % 4 == 1, F.col("sos") * 100 + 1).otherwise(F.col("sos")).cast("string")
    return positions.join(rank, "brand").select(F.col("brand").alias("entity"), "classes", F.when(n % 4 == 2, "n/a").when(n % 4 == 3, None).otherwise(share).alias("share"), F.col("rank").cast("string").alias("rank"))


_NUMBER = "regexp_extract(brand, '([0-9]+)', 1)::INT"
add("kg_value_problems", lambda s, d: G.value_problems(_entities(s, d)), f"""WITH {V.SHELF_SQL}, l AS (SELECT * FROM shelf WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf)),
  p AS (SELECT brand, count(DISTINCT CASE WHEN sos >= 0.30::DOUBLE THEN 3 WHEN sos >= 0.15::DOUBLE THEN 2 ELSE 1 END) AS classes FROM (SELECT brand, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY category_id) AS sos FROM l GROUP BY category_id, brand) GROUP BY 1),
  r AS (SELECT brand, sum(rank) % count(*) <> 0 AS broken FROM l GROUP BY 1)
  SELECT brand AS entity, problem, severity FROM p JOIN r USING (brand), (VALUES ('several classes', 'error'), ('share is no number', 'error'), ('share out of range', 'warning'), ('no rank', 'warning')) v(problem, severity)
  WHERE CASE problem WHEN 'several classes' THEN classes > 1 WHEN 'share is no number' THEN {_NUMBER} % 4 = 2 WHEN 'share out of range' THEN {_NUMBER} % 4 = 1 ELSE broken END""")
add("kg_alert_edges", lambda s, d: G.alert_edges(S.metric_alerts(S.product_history(V.shelf(s, d))), ["snapshot_date", "category_id"]).select("subject", "predicate", "object", "properties.severity", F.col("properties.snapshot_date").cast("string").alias("first")),
    f"WITH {V.SHELF_SQL} SELECT asin::VARCHAR AS subject, 'hasAlert' AS predicate, alert AS object, arg_min(severity, (snapshot_date, category_id, severity)) AS severity, min(snapshot_date)::VARCHAR AS first FROM ({A.ALERTS}) GROUP BY asin, alert")

TIME_WORDS = {"view": "today", "click": "this_week", "purchase": "last_month", "signup": "soon", "error": None}


def _fresh(s, d):
    """Claims by what each user did last of a kind, against the newest event of the table."""
    e = V.table(s, d, "events")
    words = F.create_map(*(F.lit(x) for p in TIME_WORDS.items() if p[1] for x in p))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    last = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return last.crossJoin(now).select("user_id", "event_type", C.freshness(words[F.col("event_type")], F.when(F.col("user_id") % 10 > 0, F.col("last")), F.col("now")).alias("x")).select("user_id", "event_type", "x.*")


add("fresh_claims", _fresh, """WITH l AS (SELECT user_id, event_type, CASE WHEN user_id % 10 > 0 THEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) END AS age, 86400000000 * CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'purchase' THEN 62 ELSE 7 END AS allowed FROM events GROUP BY 1, 2)
  SELECT user_id, event_type, CASE WHEN age IS NULL THEN 'unknown' WHEN age <= allowed THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN age IS NULL THEN 0 WHEN age <= allowed THEN 1 - age::DOUBLE / allowed ELSE 0.3 END::DOUBLE AS confidence FROM l""", "confidence")


def _nested(s, d):
    """Quarterly reports: sales by region, and by brand in a region, and events, nested."""
    o = V.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    c = V.table(s, d, "customer").join(V.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(V.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_mktsegment", "r_name")
    per = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), "r_name", "c_mktsegment").agg(F.sum("cents").alias("cents"), F.count("*").alias("orders"))
    regions = per.groupBy("year", "quarter", "r_name").agg(F.sum("cents").alias("cents")).groupBy("year", "quarter").agg(F.collect_list(F.struct(F.col("r_name").alias("region"), "cents")).alias("regions"))
    brands = per.groupBy("year", "quarter").agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("brand"), F.col("r_name").alias("region"), "orders")).alias("brands"), F.collect_list(F.concat(F.lit("Fair in "), "r_name", F.lit(" for "), F.initcap("c_mktsegment"))).alias("events"))
    return regions.join(brands, ["year", "quarter"])


_NESTED = "SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, {c} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {w} GROUP BY ALL"
add("report_regions", lambda s, d: D.of_reports(_nested(s, d), "regions", "region", "asia", ["year", "quarter"]), _NESTED.format(c="r_name AS region, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents", w="r_name = 'ASIA'"))
add("report_brands", lambda s, d: D.of_reports(_nested(s, d), "brands", "brand", "Building", ["year", "quarter"], year=1996), _NESTED.format(c="c_mktsegment AS brand, r_name AS region, count(*) AS orders", w="c_mktsegment = 'BUILDING' AND year(o_orderdate) = 1996"))
add("report_events", lambda s, d: D.report_events(_nested(s, d), "events", ["europe", "MACHINERY"], ["year", "quarter"]), _NESTED.format(c="'Fair in ' || r_name || ' for ' || c_mktsegment[1] || lower(c_mktsegment[2:]) AS event", w="r_name = 'EUROPE' OR c_mktsegment = 'MACHINERY'"))


# --- a stream read to its end


def _streamed(s, d):
    """Events come in four files, out of order; the last 100 of every user."""
    folder, e = _folder(s, "stream"), V.table(s, d, "events").select("user_id", "ts", "event_id", "value")
    e.repartition(4, "event_id").write.parquet(f"{folder}/events")
    stream = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    return W.read_to_end(W.last_figures(stream, "user_id", "ts", "event_id", "value"), ["user_id"], folder)


add("last_figures_streamed", _streamed, """SELECT user_id, n, mean, least, v[n // 2 + 1] AS p50, v[floor(n * 0.9::DOUBLE)::INT + 1] AS p90, v[floor(n * 0.99::DOUBLE)::INT + 1] AS p99
  FROM (SELECT user_id, count(*) AS n, fsum(value) / count(*) AS mean, min(value) AS least, list(value ORDER BY value) AS v FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY 1)""", "mean")

LIMITS = [("error", ">", 50.0, "critical"), ("purchase", ">=", 90.0, "warning"), ("view", "<", 1.0, "info"), ("click", "~", 1.0, "none")]


def _acted(s, d):
    """Events in four files and one of the files again, against rules; an unknown operator never holds."""
    folder, e = _folder(s, "actions"), V.table(s, d, "events").select("event_id", F.col("event_type").alias("metric"), "value")
    for part in (e, e.where("event_id % 4 = 1")):
        part.repartition(4, "event_id").write.mode("append").parquet(f"{folder}/events")
    stream = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    W.rule_actions(stream, s.createDataFrame(LIMITS, "metric string, op string, limit double, severity string"), f"{folder}/actions", ["event_id"], f"{folder}/state")
    return s.read.parquet(f"{folder}/actions").select("event_id", "metric", "value", "severity")


add("rule_actions_streamed", _acted, "SELECT event_id, event_type AS metric, value, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity FROM events WHERE event_type = 'error' AND value > 50 OR event_type = 'purchase' AND value >= 90 OR event_type = 'view' AND value < 1")


HELD, HELD_AT_MOST = 6 * 3600, 3


def _held(s, d):
    """Events in four files, out of order, and a part of them again; beyond the lateness one event that ends the stream."""
    folder, e = _folder(s, "held"), V.table(s, d, "events").select("event_type", "ts", "event_id")
    last = e.agg(F.lit("end").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    for part in (e.repartition(4, "event_id"), e.where("event_id % 4 = 1"), last):
        part.write.mode("append").parquet(f"{folder}/events")
    stream = s.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/events")
    out = suppression.suppressed(stream, "event_type", "ts", "event_id", HELD, HELD_AT_MOST, "60 days")
    return suppression.appended(out, folder).select("event_type", "event_id", "suppressed")


# every file holds events of the whole month: only a lateness beyond it keeps all
add("suppressed_stream", _held, f"""WITH RECURSIVE opened AS (SELECT event_type, min(ts) AS first FROM events GROUP BY 1
  UNION ALL SELECT o.event_type, min(e.ts) FROM opened o JOIN events e ON e.event_type = o.event_type AND e.ts > o.first + INTERVAL {HELD} SECOND GROUP BY 1),
  placed AS (SELECT e.event_type, event_id, row_number() OVER (PARTITION BY e.event_type, first ORDER BY e.ts, event_id) - {HELD_AT_MOST} AS over_most FROM events e ASOF JOIN opened o ON o.event_type = e.event_type AND o.first <= e.ts)
  SELECT event_type, event_id, greatest(0, over_most) AS suppressed FROM placed WHERE over_most <= 1 OR over_most % 10 = 0""")

# --- text files

#: Documents a file.
FILE_ROWS = 250


def _line_file(s, d):
    """Documents as JSON lines: of a file's, every seventh is cut, every eleventh
    repeats the number before, every thirteenth has no text; each file begins with a comment."""
    folder, i = _folder(s, "lines"), F.col("doc_id")
    body = F.to_json(F.struct(F.when(i % 11 == 5, i - 1).otherwise(i).alias("id"), F.when(i % 13 != 6, F.col("text")).alias("question")))
    line = F.when(i % 7 == 3, F.substring(body, 1, 8)).otherwise(body)
    rows = V.table(s, d, "documents").select(F.floor(i / FILE_ROWS).cast("long").alias("shard"), i.alias("place"), line.alias("value"))
    heads = rows.select("shard").distinct().select("shard", F.lit(-1).cast("long").alias("place"), F.lit("# items").alias("value"))
    rows.union(heads).repartition("shard").sortWithinPartitions("shard", "place").select("shard", "value").write.partitionBy("shard").text(folder)
    return files.json_lines(s, folder, "id long, question string")


def _shard():
    return F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long").alias("shard")


_LINES = f"""(SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) + 1 AS number FROM (SELECT doc_id, doc_id // {FILE_ROWS} AS shard, doc_id % 7 = 3 AS broken, CASE WHEN doc_id % 11 = 5 THEN doc_id - 1 ELSE doc_id END AS id,
  doc_id % 13 <> 6 AND coalesce(regexp_matches(text, '\\S'), false) AS filled FROM documents))"""
add("json_lines_read", lambda s, d: _line_file(s, d).where("bad is null").select(_shard(), "number", "item.id", F.sha2("item.question", 256).alias("digest")),
    f"SELECT shard, number, id, sha256(CASE WHEN doc_id % 13 <> 6 THEN text END) AS digest FROM {_LINES} JOIN documents USING (doc_id) WHERE NOT broken")
add("json_line_problems", lambda s, d: files.line_problems(_line_file(s, d), "id", "question").select(_shard(), "number", "problem"),
    f"""SELECT shard, number, unnest(list_filter([CASE WHEN broken THEN 'broken line' WHEN seen > 1 THEN 'repeated key' END, CASE WHEN NOT broken AND NOT filled THEN 'empty field' END], lambda x: x IS NOT NULL)) AS problem
  FROM (SELECT *, row_number() OVER (PARTITION BY broken, id ORDER BY shard, number) AS seen FROM {_LINES})""")


def _json_days(s, d):
    """Snapshots as JSON records by month; the last three months' come again at list
    price. Those of a year before the last month are read."""
    folder, shelf = _folder(s, "records"), tables.written(V.shelf(s, d).select("snapshot_date", "category_id", "asin", "brand", "rank", "price", "list_price"))
    last = shelf.agg(F.max("snapshot_date")).first()[0]
    files.save_records(shelf, folder)
    files.save_records(shelf.where(F.col("snapshot_date") > F.add_months(F.lit(last), -3)).withColumn("price", F.col("list_price")), folder)
    read = files.recent_records(s, folder, StructType([f for f in shelf.schema]), last, 365)
    return read.groupBy(F.col("snapshot_date").cast("string").alias("snapshot_date"), "category_id").agg(F.count("*").alias("rows"), F.sum(F.round(F.col("price") * 1_000_000).cast("long")).alias("millionths"), F.min("rank").cast("long").alias("best"))


add("json_records_by_day", _json_days, f"""WITH {V.SHELF_SQL}, m AS (SELECT max(snapshot_date) AS m FROM shelf)
  SELECT snapshot_date::VARCHAR AS snapshot_date, category_id, count(*) AS rows, sum(round((CASE WHEN snapshot_date > m - INTERVAL 3 MONTH THEN list_price ELSE price END) * 1000000)::BIGINT)::BIGINT AS millionths, min(rank)::BIGINT AS best FROM shelf, m WHERE snapshot_date >= m - INTERVAL 365 DAY GROUP BY shelf.snapshot_date, 2""")

SHEET = ["snapshot_date", "asin", "brand", "product_name", "units"]


def _sheet_days(s, d):
    """Sales as sheet rows of strings; of 1997, all of one brand, in whatever spelling."""
    folder, p = _folder(s, "sheet"), X._listing(V.table(s, d, "part"))
    sold = V.table(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    sold.select(F.col("l_shipdate").cast("date").cast("string").alias("snapshot_date"), F.col("p_partkey").cast("string").alias("asin"), "brand", F.col("title").alias("product_name"), F.col("l_quantity").cast("long").cast("string").alias("units")).write.option("header", True).option("escape", '"').csv(folder)
    rows = files.sheet(s, folder, SHEET, "1997-01-01", "1997-12-31", "TREE HUT")
    return rows.groupBy("asin", "brand").agg(F.count("*").alias("rows"), F.sum(F.col("units").try_cast("long")).alias("units"), F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last"))


add("sheet_history", _sheet_days, f"""SELECT p_partkey::VARCHAR AS asin, brand, count(*) AS rows, sum(l_quantity::BIGINT)::BIGINT AS units, min(l_shipdate::DATE)::VARCHAR AS first, max(l_shipdate::DATE)::VARCHAR AS last
  FROM lineitem JOIN ({X.SQL['normal_brands']}) ON l_partkey = p_partkey WHERE l_shipdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND lower(brand) = 'tree hut' GROUP BY 1, 2""")
