"""Dashboard, scan and join queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfloom.functions import scalars as X
from shelfloom.operators import dashboard as D
from shelfloom.operators import deals as L
from shelfloom.operators import graph as G
from shelfloom.operators import period as P
from shelfloom.operators import shelf as S
from shelfloom.sources import views as V
from shelfloom.sources.tables import written

TARGET = "Brand#23"
QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql, doubles="", dates=""):
    """Register a plan over (spark, folder) with its SQL; doubles are rounded to 6 digits and dates are text on both sides."""
    cols, days = doubles.split(), dates.split()
    QUERIES[name] = lambda spark, sf: plan(spark, sf).withColumns({c: F.round(F.col(c), 6) for c in cols} | {c: F.col(c).cast("string") for c in days})
    replaced = [f"round({c}, 6) AS {c}" for c in cols] + [f"CAST({c} AS VARCHAR) AS {c}" for c in days]
    SQL[name] = f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({sql})" if replaced else sql


def of(source):
    views = {V.shelf: V.SHELF_SQL, V.deals: V.DEALS_SQL, V.triples: V.TRIPLES_SQL, V.runs: V.RUNS_SQL, V.latest_shelf: V.SHELF_SQL}[source]

    def register(name, plan, sql, doubles="", dates=""):
        add(name, lambda spark, sf: plan(source(spark, sf)), f"WITH {views} {sql}", doubles, dates)

    return register


def on(name):
    return lambda plan: lambda spark, sf: plan(V.table(spark, sf, name))


IS = f"(upper(brand) LIKE '%{TARGET.upper()}%' OR upper(product_name) LIKE '%{TARGET.upper()}%')"
OWNED = f"brand = '{TARGET}'"
NOW = "snapshot_date = (SELECT max(snapshot_date) FROM shelf)"


def mine():
    return P.is_target(TARGET)


def own():
    return F.col("brand") == TARGET


shelf, deals, triples = of(V.shelf), of(V.deals), of(V.triples)
#: Plans that read the newest month alone.
now = of(V.latest_shelf)

shelf("history_range", lambda s: D.history(s, 365).select("snapshot_date", "category_id", "rank", "asin"), "SELECT snapshot_date, category_id, rank, asin FROM shelf WHERE snapshot_date >= (SELECT max(snapshot_date) FROM shelf) - INTERVAL 365 DAY ORDER BY snapshot_date DESC, category_id, rank LIMIT 10000", "", "snapshot_date")
now("products_of_brand", lambda s: D.products_of(s, TARGET).select("category_id", "asin", "price", "rating"), f"SELECT category_id, asin, price, rating FROM shelf WHERE {NOW} AND {OWNED}", "price rating")
shelf("category_share_average", lambda s: D.category_share_average(s, mine()), f"SELECT category_id, avg(sos) AS avg_sos, count(*) AS days FROM (SELECT category_id, snapshot_date, count(*) FILTER ({IS})::DOUBLE / count(*) AS sos FROM shelf GROUP BY 1, 2) GROUP BY 1", "avg_sos")
shelf("daily_history", lambda s: D.daily_history(s, mine()), f"SELECT snapshot_date, count(*) / 100.0::DOUBLE AS sos, avg(rank) AS avg_rank, count(*) FILTER (rank <= 10) AS top10 FROM shelf WHERE {IS} GROUP BY 1", "sos avg_rank", "snapshot_date")
now("priority_counts", lambda s: D.at_latest(s).groupBy("category_id", D.priority(F.col("rank")).alias("priority")).agg(F.count("*").alias("products")), f"SELECT category_id, CASE WHEN rank <= 5 THEN 'P1' WHEN rank <= 20 THEN 'P2' ELSE 'P3' END AS priority, count(*) AS products FROM shelf WHERE {NOW} GROUP BY 1, 2")
now("home_status", lambda s: D.home_status(s, mine()), f"SELECT top10, CASE WHEN top10 >= 3 THEN 'strong' WHEN top10 >= 1 THEN 'present' ELSE 'absent' END AS status FROM (SELECT count(*) FILTER ({IS} AND rank <= 10) AS top10 FROM shelf WHERE {NOW})")
shelf("change_since_oldest", D.since_oldest, "SELECT snapshot_date, category_id, asin, rank, first_rank, rank - first_rank AS change FROM (SELECT *, CASE WHEN row_number() OVER w > 1 THEN first_value(rank) OVER w END AS first_rank FROM shelf WINDOW w AS (PARTITION BY category_id, asin ORDER BY snapshot_date))", "", "snapshot_date")
PRIOR = """SELECT s.snapshot_date, s.category_id, s.asin, s.brand, s.rank, coalesce(b.rank, 100) AS prior, coalesce(b.rank, 100) - s.rank AS gain FROM shelf s
  JOIN (SELECT *, lag(snapshot_date) OVER (PARTITION BY category_id ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date, category_id FROM shelf)) d ON d.category_id = s.category_id AND d.snapshot_date = s.snapshot_date AND before IS NOT NULL
  LEFT JOIN shelf b ON b.category_id = s.category_id AND b.asin = s.asin AND b.snapshot_date = before"""
shelf("change_since_previous", D.since_previous, PRIOR, "", "snapshot_date")
now("competitor_against_own", lambda s: D.against_own(D.at_latest(s).where(~own()), D.at_latest(s).where(own()), "product_name"),
      f"SELECT t.category_id, t.asin, t.brand, o.asin AS own_asin, t.price - o.price AS price_gap, t.rating - o.rating AS rating_gap FROM (SELECT * FROM shelf WHERE {NOW} AND NOT {OWNED}) t LEFT JOIN (SELECT * FROM shelf WHERE {NOW} AND {OWNED} QUALIFY row_number() OVER (PARTITION BY product_name ORDER BY rank, asin) = 1) o USING (product_name)", "price_gap rating_gap")
now("competitor_averages", lambda s: D.brand_averages(D.at_latest(s), own()), f"SELECT brand, count(*) AS products, avg(price) AS avg_price, avg(rating) AS avg_rating, avg(price) - (SELECT avg(price) FROM shelf WHERE {NOW} AND {OWNED}) AS price_gap, avg(rating) - (SELECT avg(rating) FROM shelf WHERE {NOW} AND {OWNED}) AS rating_gap FROM shelf WHERE {NOW} AND NOT {OWNED} GROUP BY 1", "avg_price avg_rating price_gap rating_gap")
shelf("latest_brands", D.latest_brands, f"SELECT brand, count(*) AS rows, avg(rank) AS avg_rank, min(rank) AS best_rank FROM shelf WHERE brand IN (SELECT brand FROM shelf WHERE {NOW}) GROUP BY 1", "avg_rank")
shelf("brand_summary", D.summary, "SELECT brand, count(*) AS rows, avg(rank) AS avg_rank, avg(rating) AS avg_rating, min(snapshot_date) AS first, max(snapshot_date) AS last, count(*)::DOUBLE / (SELECT count(*) FROM shelf) AS share FROM shelf GROUP BY 1 ORDER BY rows DESC, brand LIMIT 20", "avg_rank avg_rating share", "first last")
shelf("brand_view", lambda s: D.brand_view(s, mine()), f"SELECT sos, products, avg_rank, top10, avg_price, sos - lead(sos) OVER (ORDER BY snapshot_date DESC) AS sos_delta FROM (SELECT snapshot_date, count(*) FILTER ({IS})::DOUBLE / count(*) AS sos, count(*) FILTER ({IS}) AS products, avg(rank) FILTER ({IS}) AS avg_rank, count(*) FILTER ({IS} AND rank <= 10) AS top10, avg(price) FILTER ({IS}) AS avg_price FROM shelf GROUP BY 1) ORDER BY snapshot_date DESC LIMIT 1", "sos avg_rank avg_price sos_delta")
TRACKED = ["Brand#11", "Brand#12", "Brand#55"]
now("competitor_list", lambda s: D.competitor_list(s, own(), TRACKED), f"SELECT brand, products, avg_rank, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY products DESC, brand) AS n FROM (SELECT brand, count(*) AS products, avg(rank) AS avg_rank, CASE WHEN brand IN ('Brand#11', 'Brand#12', 'Brand#55') THEN 'tracked' ELSE 'organic' END AS kind FROM shelf WHERE {NOW} AND NOT {OWNED} GROUP BY 1)) WHERE kind = 'tracked' OR n <= 7 ORDER BY products DESC, brand LIMIT 10", "avg_rank")
shelf("price_index_trend", lambda s: D.price_index_trend(s, mine(), "PROMO"), f"SELECT snapshot_date, coalesce(100 * avg(price) FILTER ({IS}) / avg(price), 100) AS cpi FROM shelf WHERE category_id = 'PROMO' GROUP BY 1", "cpi", "snapshot_date")
now("competitor_promotions", lambda s: D.promotions(s, own()), f"SELECT brand, count(*) AS products, count(*) FILTER (discount_percent > 5) AS promoted, max(discount_percent) AS max_discount FROM shelf WHERE {NOW} AND NOT {OWNED} GROUP BY 1 HAVING count(*) FILTER (discount_percent > 5) > 0 ORDER BY promoted DESC, max_discount DESC, brand LIMIT 15", "max_discount")
shelf("morning_brief", lambda s: D.morning_brief(s, own()), f"SELECT kind, category_id, asin, brand, rank, gain FROM (SELECT *, unnest([CASE WHEN rank <= 50 AND gain >= 10 THEN 'riser' WHEN rank <= 50 AND gain <= -10 THEN 'faller' END, CASE WHEN {OWNED} AND rank <= 5 THEN 'highlight' END]) AS kind FROM ({PRIOR})) WHERE kind IS NOT NULL AND {NOW}")
_M = f"SELECT category_id, asin, min_by(rank, snapshot_date) AS start_rank, max_by(rank, snapshot_date) AS end_rank, count(*) AS seen, max(brand) AS brand, min_by(rank, snapshot_date) - max_by(rank, snapshot_date) AS move FROM shelf WHERE {IS} GROUP BY 1, 2 HAVING count(*) >= 2"
shelf("target_movers", lambda s: P.movers(s.where(mine())), f"(SELECT *, 'riser' AS kind FROM ({_M}) WHERE move > 5 ORDER BY move DESC, category_id, asin LIMIT 10) UNION ALL (SELECT *, 'faller' FROM ({_M}) WHERE move < -5 ORDER BY move, category_id, asin LIMIT 10)")
now("target_top_products", lambda s: D.at_latest(s).where(mine()).orderBy("rank", "category_id").limit(10).select("category_id", "asin", "rank"), f"SELECT category_id, asin, rank FROM shelf WHERE {NOW} AND {IS} ORDER BY rank, category_id LIMIT 10")
shelf("category_average_share", lambda s: s.groupBy("category_id").agg(F.count_distinct("brand").alias("brands")).select("category_id", "brands", (100.0 / F.col("brands")).alias("avg_sos")), "SELECT category_id, count(DISTINCT brand) AS brands, 100.0::DOUBLE / count(DISTINCT brand) AS avg_sos FROM shelf GROUP BY 1", "avg_sos")
add("sibling_nations", lambda s, d: D.siblings(V.table(s, d, "nation"), "n_regionkey", "n_name"), "SELECT x.n_regionkey, x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name <> y.n_name")
add("new_documents", lambda s, d: V.table(s, d, "documents").join(V.table(s, d, "labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
add("mapped_brands", lambda s, d: D.with_mapping(V.deals(s, d).select("asin", "brand"), V.table(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("asin"), F.lower("p_brand").alias("brand")), "asin", "brand").groupBy("brand").agg(F.count("*").alias("n")),
    f"WITH {V.DEALS_SQL} SELECT CASE WHEN asin % 2 = 0 THEN lower(brand) ELSE brand END AS brand, count(*) AS n FROM deals GROUP BY 1")
ALIASES = [("price", "cost"), ("cheap", "cost"), ("dog", "animal"), ("data", "data"), ("model", "data")]
add("alias_entities", on("conversations")(lambda c: c.select(F.explode(D.contained(F.col("text"), ALIASES)).alias("entity")).groupBy("entity").agg(F.count("*").alias("turns"))),
    "SELECT entity, count(*) AS turns FROM (SELECT unnest(list_distinct([" + ", ".join(f"CASE WHEN contains(lower(text), '{a}') THEN '{e}' END" for a, e in ALIASES) + "])) AS entity FROM conversations) WHERE entity IS NOT NULL GROUP BY 1")
CLUSTERS = [("reach", ["viewed", "click"]), ("sale", ["purchase", "sign"])]
add("tag_clusters", on("events")(lambda e: e.groupBy(D.cluster_of(F.col("event_type"), CLUSTERS).alias("cluster")).agg(F.count("*").alias("events"))),
    "SELECT CASE WHEN event_type IN ('view', 'click') THEN 'reach' WHEN event_type IN ('purchase', 'signup') THEN 'sale' END AS cluster, count(*) AS events FROM events GROUP BY 1")
WORDS = {"good": "positive", "great": "positive", "tion": "positive", "bad": "negative", "poor": "negative", "ing": "negative"}
add("keyword_frequency", on("documents")(lambda d: D.keyword_frequency(d, WORDS)), " UNION ALL ".join(f"SELECT '{w}' AS keyword, count(*) AS texts, '{k}' AS kind FROM documents WHERE contains(lower(text), '{w}') HAVING count(*) > 0" for w, k in WORDS.items()))
add("trade_summary", lambda s, d: D.trade_summary(V.table(s, d, "supplier").join(F.broadcast(V.table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")), "n_name"), "SELECT n_name, count(*) AS n, (SELECT count(*) FROM supplier) AS total, count(*)::DOUBLE / (SELECT count(*) FROM supplier) AS share FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 5", "share")
shelf("discount_dependency", D.discount_dependency, "SELECT category_id, asin, CASE WHEN count(*) > 1 THEN round(100.0::DOUBLE * count(*) FILTER (both_up) / (count(*) - 1), 1) ELSE 0 END AS score, count(*) AS seen FROM (SELECT *, coalesce(discount_percent > lag(discount_percent) OVER w AND rank < lag(rank) OVER w, false) AS both_up FROM shelf WINDOW w AS (PARTITION BY category_id, asin ORDER BY snapshot_date)) GROUP BY 1, 2")
shelf("premium_defense", lambda s: s.join(s.groupBy("category_id").agg(F.avg("price").alias("mean")), "category_id").groupBy(D.premium_defense(F.col("price"), F.col("mean"), F.col("rank")).alias("score")).agg(F.count("*").alias("rows")),
      "SELECT CASE WHEN 100 * (price - mean) / mean > 20 THEN CASE WHEN rank <= 10 THEN 90 WHEN rank <= 30 THEN 70 ELSE 40 END ELSE 50 END AS score, count(*) AS rows FROM (SELECT *, avg(price) OVER (PARTITION BY category_id) AS mean FROM shelf) GROUP BY 1")
shelf("share_drops", lambda s: D.share_drops(S.share_of_shelf(s)), "SELECT * FROM (SELECT snapshot_date, category_id, brand, lag(sos) OVER (PARTITION BY category_id, brand ORDER BY snapshot_date) - sos AS \"drop\" FROM (SELECT snapshot_date, category_id, brand, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY snapshot_date, category_id) AS sos FROM shelf GROUP BY 1, 2, 3)) WHERE \"drop\" >= 0.02 - 1e-9", "\"drop\"".strip('"'), "snapshot_date")
SQL["share_drops"] = SQL["share_drops"].replace("round(drop, 6) AS drop", 'round("drop", 6) AS "drop"')
END = "1997-06-30"
add("relevance_tiers", on("orders")(lambda o: o.groupBy(D.relevance_tier(F.to_date("o_orderdate"), F.lit(END).cast("date"), F.col("o_orderpriority") == "1-URGENT").alias("tier")).agg(F.count("*").alias("signals"))),
    f"SELECT CASE WHEN abs(o_orderdate::DATE - DATE '{END}') <= 7 THEN 'core' WHEN abs(o_orderdate::DATE - DATE '{END}') <= 30 OR o_orderpriority = '1-URGENT' THEN 'background' END AS tier, count(*) AS signals FROM orders GROUP BY 1")
add("recent_signals", on("orders")(lambda o: o.where((F.date_format("o_orderdate", "yyyy-MM-dd") >= "1998-01-01") & F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(F.count("*").alias("signals"))), "SELECT o_orderstatus, count(*) AS signals FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY 1")
add("valid_periods", lambda s, d: V.table(s, d, "orders").join(V.table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderdate").alias("valid_from"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("valid_to")).where(D.valid_at(F.lit("1997-06-30").cast("timestamp"))).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("orders")),
    "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate <= TIMESTAMP '1997-06-30' AND (l_returnflag = 'N' OR l_shipdate >= TIMESTAMP '1997-06-30')")
FILTER = {"$or": [{"p_type": {"$in": ["PROMO", "STANDARD"]}}, {"$and": [{"p_brand": TARGET}, {"p_size": 10}]}]}
add("metadata_filter", on("part")(lambda p: p.where(D.metadata_filter(FILTER)).groupBy("p_type").agg(F.count("*").alias("n"))), f"SELECT p_type, count(*) AS n FROM part WHERE p_type IN ('PROMO', 'STANDARD') OR (p_brand = '{TARGET}' AND p_size = 10) GROUP BY 1")
add("plausible_prices", on("lineitem")(lambda i: i.where((F.col("l_extendedprice") / F.col("l_quantity")).between(0.5, 1000)).agg(F.count("*").alias("n"))), "SELECT count(*) AS n FROM lineitem WHERE l_extendedprice / l_quantity BETWEEN 0.5 AND 1000")
shelf("keyword_products", lambda s: s.where(F.lower("product_name").rlike("red|blue|ing|a")).groupBy("product_name").agg(F.count("*").alias("n")), "SELECT product_name, count(*) AS n FROM shelf WHERE regexp_matches(lower(product_name), 'red|blue|ing|a') GROUP BY 1")

deals("competitor_deals", lambda d: L.competitor_deals(d, TARGET, "#1", 24 * 60).select("snapshot_datetime", "asin", "brand", "discount_percent"), f"SELECT snapshot_datetime, asin, brand, discount_percent FROM deals WHERE brand <> '{TARGET}' AND contains(lower(brand), '#1') AND snapshot_datetime >= (SELECT max(snapshot_datetime) FROM deals) - INTERVAL 1440 HOUR", "", "snapshot_datetime")
deals("deals_overview", L.overview, "SELECT count(*) AS deals, count(*) FILTER (deal_type = 'lightning') AS lightning, count(DISTINCT brand) AS brands, count(DISTINCT CAST(snapshot_datetime AS DATE)) AS days, avg(discount_percent) AS avg_discount FROM deals", "avg_discount")

triples("kg_terms", lambda t: G.terms(t, predicate="parentCategory"), "SELECT DISTINCT 'subject' AS place, subject AS term FROM triples WHERE predicate = 'parentCategory' UNION ALL SELECT DISTINCT 'object', object FROM triples WHERE predicate = 'parentCategory'")
triples("kg_brand_products", lambda t: G.brand_products(t, TARGET, "PROMO"), f"SELECT a.object AS product, b.object AS category FROM triples a JOIN triples b ON a.object = b.subject WHERE a.predicate = 'hasProduct' AND b.predicate = 'belongsToCategory' AND a.subject = '{TARGET}' AND b.object = 'PROMO'")
NEXT = "SELECT *, row_number() OVER (PARTITION BY here, direction ORDER BY predicate, there) AS n FROM (SELECT subject AS here, predicate, object AS there, 'out' AS direction FROM triples UNION ALL SELECT object, predicate, subject, 'in' FROM triples)"
triples("kg_entity_context", lambda t: G.entity_context(t, "NATION_3", 2), f"SELECT DISTINCT 1 AS depth, here, predicate, there, direction FROM ({NEXT}) WHERE here = 'NATION_3' AND n <= 5 UNION ALL SELECT DISTINCT 2, b.here, b.predicate, b.there, b.direction FROM ({NEXT}) b WHERE b.n <= 5 AND b.here IN (SELECT there FROM ({NEXT}) WHERE here = 'NATION_3' AND n <= 5)")
triples("kg_children", lambda t: G.children(t, "EUROPE"), "SELECT subject AS child FROM triples WHERE predicate = 'parentCategory' AND object = 'EUROPE'")
triples("kg_product_context", lambda t: G.product_context(t, "P1"), "SELECT subject AS product, object AS category, (SELECT count(*) FROM triples x WHERE x.predicate = 'belongsToCategory' AND x.object = t.object) AS siblings FROM triples t WHERE predicate = 'belongsToCategory' AND subject = 'P1'")
# the edges of one category are taken away first, so that there is something to find
triples("kg_consistency", lambda t: G.inconsistencies(t.where("not (predicate = 'belongsToCategory' and object = 'PROMO')")), "SELECT subject AS entity, 'no category' AS problem, 'warning' AS severity FROM triples WHERE predicate = 'belongsToCategory' AND object = 'PROMO'")
triples("kg_insert_checked", lambda t: G.insert_checked(t, t.where("predicate = 'hasProduct'").select(F.col("object").alias("subject"), "predicate", F.col("subject").alias("object"), "confidence").union(t.where("predicate = 'originatesFrom'").withColumn("confidence", F.lit(1.0)))).groupBy("predicate").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence")), "SELECT predicate, count(*) AS n, CASE WHEN predicate LIKE '%Competitor' THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM triples GROUP BY 1")
shelf("kg_metric_edges", lambda s: G.metric_edges(S.share_of_shelf(s), ["category_id", "brand"], "snapshot_date", {"sos": "hasShare", "products": "hasProducts"}).groupBy("predicate").agg(F.count("*").alias("edges"), F.sum("value").alias("total")), "SELECT predicate, count(*) AS edges, sum(v) AS total FROM (SELECT unnest(['hasShare', 'hasProducts']) AS predicate, unnest([c / n, c]) AS v FROM (SELECT *, sum(c) OVER (PARTITION BY snapshot_date, category_id)::DOUBLE AS n FROM (SELECT snapshot_date, category_id, brand, count(*)::DOUBLE AS c FROM shelf GROUP BY 1, 2, 3))) GROUP BY 1", "total")
triples("kg_entity_facts", lambda t: G.entity_facts(t, t.where("predicate = 'parentCategory'").select(F.col("object").alias("entity")).distinct()), """SELECT entity, predicate, other, direction FROM (SELECT DISTINCT e.entity, predicate, other, direction FROM (SELECT subject AS entity, predicate, object AS other, 'out' AS direction FROM triples UNION ALL SELECT object, predicate, subject, 'in' FROM triples) w
  JOIN (SELECT DISTINCT object AS entity FROM triples WHERE predicate = 'parentCategory') e USING (entity)) QUALIFY row_number() OVER (PARTITION BY entity, predicate, direction ORDER BY other) <= 5""")
triples("kg_enriched", lambda t: G.enriched(t.select(F.col("subject").alias("brand")).distinct(), t), """SELECT brand, coalesce(kg_products, 0) AS kg_products, coalesce(kg_categories, 0) AS kg_categories, coalesce(kg_rivals, 0) AS kg_rivals FROM (SELECT DISTINCT subject AS brand FROM triples)
  LEFT JOIN (SELECT a.subject AS brand, count(DISTINCT a.object) AS kg_products, count(DISTINCT b.object) AS kg_categories FROM triples a LEFT JOIN triples b ON a.object = b.subject AND b.predicate = 'belongsToCategory' WHERE a.predicate = 'hasProduct' GROUP BY 1) USING (brand)
  LEFT JOIN (SELECT brand, count(DISTINCT other) AS kg_rivals FROM (SELECT subject AS brand, object AS other FROM triples WHERE predicate LIKE '%Competitor' UNION ALL SELECT object, subject FROM triples WHERE predicate LIKE '%Competitor') GROUP BY 1) USING (brand)""")
triples("kg_round_trip", lambda t: written(t).groupBy("predicate").agg(F.count("*").alias("n")), "SELECT predicate, count(*) AS n FROM triples GROUP BY 1")

# --- alerts, text sources

ALERTS = "SELECT event_id AS id, ts, value, event_id % 3 = 0 AS sent FROM events WHERE event_type = 'error' AND value > 50"


def _alerts(s, d):
    return V.table(s, d, "events").where("event_type = 'error' and value > 50").select(F.col("event_id").alias("id"), "ts", "value", (F.col("event_id") % 3 == 0).alias("sent"))


add("unsent_alerts", lambda s, d: _alerts(s, d).where(~F.col("sent")).orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "value"), f"SELECT id, value FROM ({ALERTS}) WHERE NOT sent ORDER BY ts DESC, id DESC LIMIT 50")
add("alerts_marked_sent", lambda s, d: P.upsert(_alerts(s, d), _alerts(s, d).where("value > 90").withColumn("sent", F.lit(True)), ["id"]).groupBy("sent").agg(F.count("*").alias("n")), f"SELECT sent OR value > 90 AS sent, count(*) AS n FROM ({ALERTS}) GROUP BY 1")


def _sheet(p):
    """Parts as a sheet of strings, one price in seven missing."""
    text = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand"), F.when(F.col("p_partkey") % 7 == 0, "N/A").otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2))).alias("price"))
    return text.select(F.col("id").try_cast("long").alias("id"), "brand", X.number(F.col("price")).alias("price"))


add("sheet_rows", on("part")(lambda p: _sheet(p).groupBy("brand").agg(F.count("*").alias("rows"), F.count("price").alias("prices"), F.sum(F.round(F.col("price") * 100).cast("long")).alias("cents"))), "SELECT p_brand AS brand, count(*) AS rows, count(*) FILTER (p_partkey % 7 <> 0) AS prices, sum(round(p_retailprice * 100)::BIGINT) FILTER (p_partkey % 7 <> 0)::BIGINT AS cents FROM part GROUP BY 1")
add("json_records", on("events")(lambda e: e.select(F.from_json(F.to_json(F.struct("event_id", "event_type", F.array("value", "value").alias("pair"))), "event_id long, event_type string, pair array<double>").alias("r")).select("r.*").groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.element_at("pair", 2)).alias("most"))), "SELECT event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1")


def _lines(b):
    """JSON lines of benchmark items; every seventh is cut."""
    line = F.to_json(F.struct(F.col("item_id").alias("id"), F.col("text").alias("question")))
    rows = b.select(F.col("item_id").alias("number"), F.when(F.col("item_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("line"))
    parsed = F.from_json("line", "id long, question string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.select("number", parsed.alias("r")).select("number", (F.col("r._bad").isNull() & F.col("r.id").isNotNull()).alias("fine"))


add("json_lines_checked", on("benchmark")(_lines), "SELECT item_id AS number, item_id % 7 <> 0 AS fine FROM benchmark")
add("quarter_lookup", lambda s, d: _quarters(s, d), "SELECT quarter, c_mktsegment AS name, sum(cents)::BIGINT AS cents FROM (SELECT year(o_orderdate) * 10 + quarter(o_orderdate) AS quarter, c_mktsegment, round(o_totalprice * 100)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey) WHERE quarter = (SELECT max(year(o_orderdate) * 10 + quarter(o_orderdate)) FROM orders JOIN customer ON o_custkey = c_custkey) AND c_mktsegment <> 'MACHINERY' GROUP BY 1, 2")


def _quarters(s, d):
    """The latest of nested quarterly reports, its segments as rows."""
    quarter = (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("long").alias("quarter")
    per = V.table(s, d, "orders").join(V.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(quarter, "c_mktsegment").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    reports = per.groupBy("quarter").agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("name"), "cents")).alias("segments"))
    return reports.orderBy(F.desc("quarter")).limit(1).select("quarter", F.explode("segments").alias("x")).select("quarter", "x.*").where("name <> 'MACHINERY'")

shelf("morning_figures", lambda s: D.morning_figures(s, own()), f"SELECT products, avg_rank, top10, sos, lead(avg_rank) OVER (ORDER BY snapshot_date DESC) - avg_rank AS rank_change FROM (SELECT snapshot_date, count(*) FILTER ({OWNED}) AS products, avg(rank) FILTER ({OWNED}) AS avg_rank, count(*) FILTER ({OWNED} AND rank <= 10) AS top10, 100.0::DOUBLE * count(*) FILTER ({OWNED}) / count(*) AS sos FROM shelf GROUP BY 1) ORDER BY snapshot_date DESC LIMIT 1", "avg_rank sos rank_change")
now("category_newcomers", lambda s: D.newcomers(s, own(), 10), f"SELECT category_id, count(*) FILTER ({OWNED}) AS own, count(*) AS products, greatest(0, count(*) - count(*) FILTER ({OWNED}) - 10) AS new_competitors FROM shelf WHERE {NOW} GROUP BY 1")
