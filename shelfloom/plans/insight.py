"""Queries over rules, retrieval, evaluation, scalars and events, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfloom.functions import scalars as X
from shelfloom.operators import evaluation as E
from shelfloom.operators import period as P
from shelfloom.operators import retrieval as R
from shelfloom.operators import rules as N
from shelfloom.operators import shelf as S
from shelfloom.operators.text_index import index_of
from shelfloom.sources import views as V
from shelfloom.sources.tables import shared_folder, written
from shelfloom.streaming import monitor as M

from . import analytics as A

QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql=None, doubles="", texts=""):
    cols, dates = doubles.split(), texts.split()
    QUERIES[name] = lambda spark, sf: plan(spark, sf).withColumns({c: F.round(F.col(c), 6) for c in cols}).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in dates})
    if sql:
        replaced = [f"round({c}, 6) AS {c}" for c in cols] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in dates]
        SQL[name] = f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({sql})" if replaced else sql


def on(table):
    return lambda plan: lambda spark, sf: plan(V.table(spark, sf, table))


# --- rules

#: Month of the sales event that the event rules look at.
EVENT_MONTH = 7

CONTEXT_SQL = """quant AS (SELECT *, CASE WHEN price > 0 THEN floor(price * 1e6 + 0.5)::BIGINT END AS pq, CASE WHEN rating > 0 THEN floor(rating * 1e6 + 0.5)::BIGINT END AS rq FROM shelf),
b AS (SELECT snapshot_date, category_id, brand, count(*)::DOUBLE / max(n) AS sos, avg(rank) AS avg_rank, min(rank) AS current_rank, 100 * (sum(pq)::DOUBLE / count(pq) / 1e6) / (max(mp)::DOUBLE / max(mpc) / 1e6) AS cpi,
    sum(rq)::DOUBLE / count(rq) / 1e6 - max(mr)::DOUBLE / max(mrc) / 1e6 AS rating_gap
  FROM (SELECT *, count(*) OVER w AS n, sum(pq) OVER w AS mp, count(pq) OVER w AS mpc, sum(rq) OVER w AS mr, count(rq) OVER w AS mrc FROM quant WINDOW w AS (PARTITION BY snapshot_date, category_id)) GROUP BY 1, 2, 3),
ctx0 AS (SELECT *, sum(sos * sos) OVER g AS hhi, count(*) OVER g - 1 AS competitors, sos - lag(sos) OVER (PARTITION BY category_id, brand ORDER BY snapshot_date) AS sos_change, brand = 'Brand#23' AS is_target FROM b WINDOW g AS (PARTITION BY snapshot_date, category_id)),
h0 AS (SELECT *, row_number() OVER o AS idx, sum((rank > 10)::INT) OVER o AS miss, rank - lag(rank) OVER o AS rank_change, rank - lag(rank, 7) OVER o AS rank_change_7, price / nullif(lag(price, 7) OVER o, 0) - 1 AS price_change,
    coalesce(rank < lag(rank) OVER o, false) AS rose, coalesce(discount_percent > lag(discount_percent) OVER o, false) AS cheaper FROM shelf WINDOW o AS (PARTITION BY category_id, asin ORDER BY snapshot_date)),
h1 AS (SELECT snapshot_date, category_id, asin, brand, rank, reviews_count AS reviews, rank_change, rank_change_7, price_change, abs(coalesce(rank_change, 0)) >= 5 AS rank_shock,
    round(CASE WHEN count(*) OVER l >= 2 THEN stddev_pop(rank) OVER l END, 9) AS volatility, round(CASE WHEN count(*) OVER l >= 2 THEN covar_pop(idx::DOUBLE, CASE WHEN rating > 0 THEN rating END) OVER l / nullif(var_pop(idx::DOUBLE) OVER l, 0) END, 9) AS rating_trend,
    sum((rank <= 10)::INT) OVER (PARTITION BY category_id, asin, miss ORDER BY snapshot_date) AS streak,
    sum((rose AND discount_percent > 5)::INT) OVER f::DOUBLE / nullif(sum(rose::INT) OVER f, 0) AS discount_overlap, sum((rose AND cheaper)::INT) OVER f::DOUBLE / nullif(idx - 1, 0) AS discount_score
  FROM h0 WINDOW l AS (PARTITION BY category_id, asin ORDER BY snapshot_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), f AS (PARTITION BY category_id, asin ORDER BY snapshot_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h2 AS (SELECT *, bool_or(rank_shock) OVER (PARTITION BY snapshot_date, category_id, brand) AS shock FROM h1 QUALIFY row_number() OVER (PARTITION BY snapshot_date, category_id, brand ORDER BY rank) = 1),
churned AS (""" + A.CHURN + """),
ctx AS (SELECT ctx0.*, rank_change, rank_change_7, volatility, streak, rating_trend, price_change, discount_overlap, discount_score, reviews, shock AS rank_shock, churn_rate, month(snapshot_date) = 7 AS event_named, CASE WHEN month(snapshot_date) = 7 THEN rank_change END AS event_rank_change
  FROM ctx0 LEFT JOIN h2 USING (snapshot_date, category_id, brand) LEFT JOIN churned USING (snapshot_date, category_id))"""


def brand_context(shelf):
    """One row of metrics per (month, category, brand)."""
    m = S.brand_metrics(shelf)
    g = Window.partitionBy("snapshot_date", "category_id")
    before = Window.partitionBy("category_id", "brand").orderBy("snapshot_date")
    return m.select(
        "snapshot_date", "category_id", "brand", "sos", "avg_rank", F.col("best_rank").alias("current_rank"), "cpi", "rating_gap", F.sum(F.col("sos") * F.col("sos")).over(g).alias("hhi"),
        (F.count("*").over(g) - 1).alias("competitors"), (F.col("sos") - F.lag("sos").over(before)).alias("sos_change"), (F.col("brand") == "Brand#23").alias("is_target"),
    )


def context(spark, sf):
    """The same with the brand's best product and its category's churn: all metrics that the tables hold."""
    shelf = written(V.shelf(spark, sf))  # three metrics start from it
    churn = S.churn(shelf).select("snapshot_date", "category_id", "churn_rate")
    history = S.product_history(shelf).withColumns({c: F.round(c, 9) for c in ("volatility", "rating_trend")})  # so that 3 and 5 are whole
    event = F.month("snapshot_date") == EVENT_MONTH
    out = brand_context(shelf).join(S.best_products(history), KEYS, "left").join(churn, KEYS[:2], "left")
    return out.withColumns({"event_named": event, "event_rank_change": F.when(event, F.col("rank_change"))})


#: Metrics without a source table; those of sentiment have their own query.
ABSENT = ("trend_keywords", "has_badge", "tags", "clusters", "summary", "revenue_yoy", "growth_quarters", "growth_before", "has_campaign", "is_owned")
PICKED = [r for r in N.RULES if not any(m in r[2] for m in ABSENT)]
HITS = "\n UNION ALL ".join(f"SELECT snapshot_date, category_id, brand, '{n}' AS rule, '{g}' AS kind, {p} AS priority, {c}::DOUBLE AS confidence FROM ctx WHERE {w}" for n, g, w, p, c in PICKED)
RULE_SQL = f"WITH {V.SHELF_SQL}, {CONTEXT_SQL}, hits AS ({HITS})"
KEYS = ["snapshot_date", "category_id", "brand"]
add("rule_hits", lambda s, d: N.infer(context(s, d), KEYS).groupBy("rule", "kind", "priority", "confidence").agg(F.count("*").alias("entities")), RULE_SQL + " SELECT rule, kind, priority, confidence, count(*) AS entities FROM hits GROUP BY ALL")
add("rule_hits_top2", lambda s, d: N.infer(context(s, d), KEYS, 2).groupBy("brand", "rule").agg(F.count("*").alias("n")), RULE_SQL + " SELECT brand, rule, count(*) AS n FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY snapshot_date, category_id, brand ORDER BY priority DESC, rule) <= 2) GROUP BY ALL")
add("insight_merge", lambda s, d: N.merge_insights(N.infer(context(s, d), KEYS).select("category_id", F.col("kind").alias("text"), F.col("priority").alias("ordinal"), "confidence").distinct(), ["category_id"]),
    RULE_SQL + """ SELECT category_id, lower(text[1:50]) AS insight, list_reduce(list(confidence ORDER BY ordinal, confidence), lambda a, x: least(1, a + x / 2)) AS confidence, count(*) AS sources
      FROM (SELECT DISTINCT category_id, kind AS text, priority AS ordinal, confidence FROM hits) GROUP BY 1, 2""", "confidence")
LIMITS = [("sos", ">=", 0.1, "info"), ("cpi", ">", 110.0, "warning"), ("hhi", "<", 0.15, "info"), ("cpi", "~", 1.0, "none")]
add("threshold_rules", lambda s, d: N.thresholds(brand_context(V.shelf(s, d)).unpivot(KEYS, ["sos", "cpi", "hhi"], "metric", "value"), s.createDataFrame(LIMITS, "metric string, op string, limit double, severity string")).groupBy("metric", "severity").agg(F.count("*").alias("n")),
    f"WITH {V.SHELF_SQL}, {CONTEXT_SQL} SELECT 'sos' AS metric, 'info' AS severity, count(*) AS n FROM ctx WHERE sos >= 0.1 UNION ALL SELECT 'cpi', 'warning', count(*) FROM ctx WHERE cpi > 110 UNION ALL SELECT 'hhi', 'info', count(*) FROM ctx WHERE hhi < 0.15")

# --- retrieval

TOK = "list_filter(regexp_extract_all(lower(text), '[가-힣]+|[a-z]+|[0-9]+'), lambda x: length(x) > 1)"
add("tokens", on("benchmark")(lambda b: b.select("item_id", F.array_join(R.tokens(F.col("text")), " ").alias("tokens"))), f"SELECT item_id, array_to_string({TOK}, ' ') AS tokens FROM benchmark")
add("chunks", on("documents")(lambda d: R.paragraphs(d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))),
    "SELECT doc_id, sum(ceil(length(line) / 500.0::DOUBLE))::BIGINT AS chunks, max(least(length(line), 500))::INT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0 GROUP BY 1")
BM25_SQL = f"""WITH t AS (SELECT doc_id AS doc, {TOK} AS t FROM documents), p AS (SELECT doc, len(t) AS length, unnest(t) AS term FROM t), tf AS (SELECT doc, length, term, count(*) AS tf FROM p GROUP BY ALL),
  c AS (SELECT count(*) AS docs, avg(len(t)) AS al FROM t WHERE len(t) > 0), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT DISTINCT item_id AS query, unnest({TOK}) AS term FROM benchmark),
  s AS (SELECT query, doc, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / al))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN c GROUP BY 1, 2)
  SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc)::INT AS rank FROM s QUALIFY rank <= 10"""


def text_index(s, d):
    """The stored index of the documents; further searches of the application find it there."""
    return index_of(V.table(s, d, "documents"), f"{d}/documents", f"{shared_folder(s).rstrip('/')}/terms-{uuid.uuid4().hex}")


def bm25(s, d):
    return text_index(s, d).search(V.table(s, d, "benchmark").select(F.col("item_id").alias("query"), "text"))


add("bm25_topk", bm25, BM25_SQL.replace("2.5 /", "2.5::DOUBLE /"), "score")


def vectors(s, d):
    """Queries: every row whose id is divisible by 100, against all rows."""
    v = V.table(s, d, "embeddings").select("vec_id", "embedding")
    return R.vector_topk(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding")), v)


VEC_SQL = "SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10"
add("vector_topk", vectors, VEC_SQL, "similarity")
LISTS = "WITH a AS (SELECT l_partkey AS item, row_number() OVER (ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1 QUALIFY rank <= 100), b AS (SELECT l_partkey AS item, row_number() OVER (ORDER BY sum(l_quantity) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1 QUALIFY rank <= 100)"


def _lists(s, d):
    per = V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("c"), F.sum("l_quantity").alias("q"))
    best = lambda c: per.orderBy(F.desc(c), "item").limit(100).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "item"))).select("item", "rank")
    return [best("c"), best("q")]


add("rrf_fusion", lambda s, d: R.rrf(_lists(s, d), ["item"]), LISTS + " SELECT item, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS lists FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1", "score")
FUSE = "SELECT user_id, event_type AS source, least(avg(value) / 100, 1) AS score FROM events GROUP BY 1, 2"
WEIGHTS = {"view": 0.4, "click": 0.35, "purchase": 0.25, "signup": 0.2, "error": 0.1}
CASEW = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " END"
add("confidence_fusion", lambda s, d: R.fuse(V.table(s, d, "events").groupBy("user_id", F.col("event_type").alias("source")).agg(F.least(F.avg("value") / 100, F.lit(1.0)).alias("score")), "user_id", WEIGHTS),
    f"""SELECT user_id, sum(w * score) AS weighted, CASE WHEN min(score) <= 0 THEN 0 ELSE 1 / sum(w / nullif(score, 0)) END AS harmonic, CASE WHEN min(score) <= 0 THEN 0 ELSE exp(sum(w * ln(nullif(score, 0)))) END AS geometric, max(score) AS highest, min(score) AS lowest,
    max(score) - min(score) > 0.3 AS conflict, CASE WHEN sum(w * score) >= 0.75 THEN 'high' WHEN sum(w * score) >= 0.5 THEN 'medium' ELSE 'low' END AS level
    FROM (SELECT *, {CASEW} / sum({CASEW}) OVER (PARTITION BY user_id) AS w FROM ({FUSE}) WHERE score BETWEEN 0 AND 1) GROUP BY 1""", "weighted harmonic geometric highest lowest")
add("min_max_scores", lambda s, d: R.min_max(V.table(s, d, "events").select("event_id", "event_type", "value"), "event_type", "value"), "SELECT event_id, event_type, CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS value FROM events WINDOW w AS (PARTITION BY event_type)", "value")
INTENT = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{n}'" for n, w in R.INTENTS) + " ELSE 'general' END"
add("intent_counts", on("conversations")(lambda c: c.groupBy("role", R.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("turns"))), f"SELECT role, {INTENT} AS intent, count(*) AS turns FROM conversations GROUP BY ALL")
add("retrieval_gate", on("conversations")(lambda c: c.select("conv_id", "turn", R.gate(F.col("text")).alias("gate"))), "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(trim(text)), '^(hi|hello|thanks|thank you|bye)[!. ]*$') THEN 'greeting' WHEN length(trim(text)) < 5 THEN 'short' ELSE 'retrieve' END AS gate FROM conversations")
MASK = "text"
for pattern, to in R.SECRETS:
    MASK = f"regexp_replace({MASK}, '{pattern}', '{to}', 'g')"
add("masked_secrets", on("documents")(lambda d: d.select("doc_id", F.sha2(R.masked(F.col("text")), 256).alias("digest"))), f"SELECT doc_id, sha256({MASK}) AS digest FROM documents")
add("recent_turns", on("conversations")(lambda c: c.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("rn <= 3").select("conv_id", "turn", "role")), "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")

# --- evaluation

KNN_SQL = f"SELECT query, list(vec_id ORDER BY rank) AS found FROM ({VEC_SQL}) GROUP BY 1"


def judged(s, d):
    """Measures of the neighbours found for each query vector; gold is every vector of its label."""
    e = V.table(s, d, "embeddings").select("vec_id", "label")
    found = vectors(s, d).select("query", "vec_id", "rank").join(e.withColumnRenamed("label", "found_label"), "vec_id")
    asked = e.select(F.col("vec_id").alias("query"), "label").join(e.groupBy("label").agg(F.count("*").alias("gold")), "label")
    right = F.coalesce(F.col("found_label") == F.col("label"), F.lit(False))
    return E.ranked(found.join(asked, "query").select("query", "rank", right.alias("right"), "gold"), "query")


JUDGED = f"(SELECT * FROM ({KNN_SQL}) JOIN (SELECT vec_id AS query, label FROM embeddings) USING (query) JOIN (SELECT label, list(vec_id ORDER BY vec_id) AS gold FROM embeddings GROUP BY 1) USING (label))"
GAIN = "list_sum(list_transform(found[1:10], lambda x, i: list_contains(gold, x)::INT / log2(i + 1.0)))"
add("recall_precision_mrr", lambda s, d: judged(s, d).select("query", "recall", "precision", "mrr", "hits"),
    f"SELECT query, len(list_intersect(found, gold))::DOUBLE / len(gold) AS recall, len(list_filter(found, lambda x: list_contains(gold, x)))::DOUBLE / len(found) AS precision, coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(found, lambda x, i: CASE WHEN list_contains(gold, x) THEN i END), lambda x: x IS NOT NULL)), 0) AS mrr, list_has_any(found[1:3], gold)::INT::DOUBLE AS hits FROM {JUDGED}", "recall precision mrr")
add("ndcg", lambda s, d: judged(s, d).select("query", "standard", "retrieved"),
    f"SELECT query, {GAIN} / list_sum(list_transform(range(1, least(len(gold), 10) + 1), lambda i: 1 / log2(i + 1.0))) AS standard, CASE WHEN len(list_intersect(found, gold)) = 0 THEN 0 ELSE {GAIN} / list_sum(list_transform(range(1, len(list_intersect(found, gold)) + 1), lambda i: 1 / log2(i + 1.0))) END AS retrieved FROM {JUDGED}", "standard retrieved")
add("set_f1", lambda s, d: judged(s, d).select("query", "f1", "jaccard"),
    f"SELECT query, 2.0::DOUBLE * len(list_intersect(found, gold)) / (len(found) + len(gold)) AS f1, len(list_intersect(found, gold))::DOUBLE / len(list_distinct(list_concat(found, gold))) AS jaccard FROM {JUDGED}", "f1 jaccard")
BYDIM = "SELECT {c} FROM (SELECT o_orderstatus AS domain, o_orderpriority AS difficulty, o_totalprice / 1000 AS score FROM orders)"
add("eval_report", on("orders")(lambda o: E.report(o.select(F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("difficulty"), (F.col("o_totalprice") / 1000).alias("score")), ["domain", "difficulty"], ["score"])), BYDIM.format(c="domain, difficulty, avg(score) AS score, count(*) AS items") + " GROUP BY ROLLUP (domain, difficulty)", "score")
HALF = "SELECT o_orderpriority, avg(o_totalprice) / 300000 AS price, avg(o_orderkey % 10) / 10 AS digit FROM orders WHERE {w} GROUP BY 1"


def _halves(o, w):
    return o.where(w).groupBy("o_orderpriority").agg((F.avg("o_totalprice") / 300000).alias("price"), (F.avg(F.col("o_orderkey") % 10) / 10).alias("digit"))


add("regression_compare", on("orders")(lambda o: E.compare(_halves(o, "o_custkey % 2 = 0"), _halves(o, "o_custkey % 2 = 1"), ["o_orderpriority"], ["price", "digit"], 0.002)),
    f"SELECT o_orderpriority, metric, before, after, CASE WHEN before - after > 0.006 THEN 'critical' WHEN before - after > 0.002 THEN 'warning' WHEN before - after < -0.002 THEN 'better' ELSE 'same' END AS severity FROM (UNPIVOT ({HALF.format(w='o_custkey % 2 = 0')}) ON price, digit INTO NAME metric VALUE before) JOIN (UNPIVOT ({HALF.format(w='o_custkey % 2 = 1')}) ON price, digit INTO NAME metric VALUE after) USING (o_orderpriority, metric)", "before after")
add("histogram_quantiles", on("events")(lambda e: E.histogram(e, "event_type", "value", ["ts", "event_id"])), "SELECT event_type, len(v)::BIGINT AS n, v[len(v) // 2 + 1] AS p50, v[floor(len(v) * 0.9)::INT + 1] AS p90, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM (SELECT event_type, list(value ORDER BY value) AS v FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000) GROUP BY 1)")

# --- scalars

add("url_domain", on("pages")(lambda p: p.select("page_id", X.domain(F.col("url")).alias("domain"))), "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages")
add("query_hash", on("conversations")(lambda c: c.select("conv_id", "turn", X.query_hash(F.col("text")).alias("hash"))), "SELECT conv_id, turn, sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS hash FROM conversations")
SAMPLES = "SELECT event_id, '$' || printf('%.2f', value) AS money, (event_id % 6)::VARCHAR || '.5 out of 5' AS stars, (event_id % 3)::VARCHAR || 'h ' || (event_id % 60)::VARCHAR || 'm' AS due, (event_id % 90)::VARCHAR || 'k' AS views FROM events"


def _samples(e):
    i = F.col("event_id")
    return e.select(i, F.concat(F.lit("$"), F.format_string("%.2f", "value")).alias("money"), F.concat((i % 6).cast("string"), F.lit(".5 out of 5")).alias("stars"), F.concat((i % 3).cast("string"), F.lit("h "), (i % 60).cast("string"), F.lit("m")).alias("due"), F.concat((i % 90).cast("string"), F.lit("k")).alias("views"))


add("parse_scalars", on("events")(lambda e: _samples(e).select("event_id", X.rating(F.col("stars")).alias("rating"), X.seconds_left(F.col("due")).alias("seconds"), X.view_count(F.col("views")).alias("views"))),
    "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN event_id % 6 + 0.5::DOUBLE END AS rating, nullif(event_id % 3 * 3600 + event_id % 60 * 60, 0) AS seconds, event_id % 90 * 1000 AS views FROM events")
add("json_property", on("events")(lambda e: e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
add("user_engagement", on("events")(lambda e: e.groupBy("user_id").agg(X.engagement(F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "view")).alias("rate"))),
    "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 100.0::DOUBLE * (count(*) FILTER (event_type = 'click') + count(*) FILTER (event_type = 'purchase')) / count(*) FILTER (event_type = 'view') ELSE 0 END AS rate FROM events GROUP BY 1", "rate")
add("supplier_ranking", lambda s, d: V.table(s, d, "supplier").join(F.broadcast(V.table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"), F.max("s_acctbal").alias("best")).orderBy(F.desc("suppliers"), "n_name").limit(5),
    "SELECT n_name, count(*) AS suppliers, max(s_acctbal) AS best FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY suppliers DESC, n_name LIMIT 5")
PERIOD = "SELECT o_orderkey, o_custkey, least(o_orderdate, l_shipdate) AS a, greatest(o_orderdate, l_shipdate) AS b, l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _periods(s, d):
    o, i = V.table(s, d, "orders"), V.table(s, d, "lineitem")
    rows = o.join(i, o.o_orderkey == i.l_orderkey).select("o_orderkey", "o_custkey", F.to_date(F.least("o_orderdate", "l_shipdate")).alias("a"), F.to_date(F.greatest("o_orderdate", "l_shipdate")).alias("b"), "l_returnflag")
    return P.overlaps(rows.where("l_returnflag = 'N'"), rows.where("l_returnflag = 'R'"), "o_custkey", "a", "b", 365).select("o_orderkey", "o_custkey").distinct()


add("period_overlap", _periods, f"WITH p AS (SELECT o_orderkey, o_custkey, a::DATE AS a, b::DATE AS b, l_returnflag FROM ({PERIOD})) SELECT DISTINCT x.o_orderkey, x.o_custkey FROM p x JOIN p y ON x.o_custkey = y.o_custkey AND y.a <= x.b AND y.b >= x.a WHERE x.l_returnflag = 'N' AND y.l_returnflag = 'R'")

# --- events

add("event_windows", on("events")(M.windows), "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, avg(value) AS mean_value FROM events GROUP BY 1, 2", "mean_value", "start")
add("event_sliding", on("events")(lambda e: M.windows(e, "1 hour", "30 minutes").select("start", "event_type", "events")), "SELECT start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2", "", "start")
add("event_sessions", on("events")(lambda e: M.sessions(e).select("user_id", "start", "events")), "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce((ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE)::INT, 1) AS f FROM events)) GROUP BY user_id, s", "", "start")
add("threshold_alerts", on("events")(lambda e: M.threshold_alerts(e, {"error": 50.0, "purchase": 90.0})), "SELECT event_id, event_type, value, CASE event_type WHEN 'error' THEN 50.0::DOUBLE ELSE 90.0::DOUBLE END AS \"limit\" FROM events WHERE event_type = 'error' AND value > 50 OR event_type = 'purchase' AND value > 90")
