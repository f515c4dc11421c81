"""Queries over snapshots, promotions and triples, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfloom.operators import deals as D
from shelfloom.operators import graph as G
from shelfloom.operators import period as P
from shelfloom.operators import shelf as S
from shelfloom.sources import views as V

TARGET = "Brand#23"
QUERIES: dict = {}
SQL: dict = {}


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})  # no negative zeros


def add(name, source, plan, sql, doubles=""):
    """Register ``plan(source view)`` with its SQL; doubles are rounded to 6 digits on both sides."""
    cols = doubles.split()
    QUERIES[name] = lambda spark, sf: rounded(plan(source(spark, sf)), *cols)
    views = {V.shelf: V.SHELF_SQL, V.deals: V.DEALS_SQL, V.triples: V.TRIPLES_SQL, V.runs: V.RUNS_SQL}[source]
    body = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in cols)}) FROM ({sql})" if cols else sql
    SQL[name] = f"WITH {views}\n{body}"


add("shelf_snapshot", V.shelf, lambda s: s, "SELECT * FROM shelf", "price list_price discount_percent rating")
add("latest_snapshot", V.shelf, lambda s: s.join(F.broadcast(s.agg(F.max("snapshot_date").alias("snapshot_date"))), "snapshot_date").select("snapshot_date", "category_id", "rank", "asin"),
    "SELECT snapshot_date, category_id, rank, asin FROM shelf WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf)")
add("filtered_scan", V.shelf, lambda s: s.where("snapshot_date between '1997-01-01' and '1997-12-01'").where(F.lower("brand") == TARGET.lower()).select("snapshot_date", "category_id", "rank", "asin").orderBy(F.desc("snapshot_date"), "category_id", "rank").limit(1000),
    f"SELECT snapshot_date, category_id, rank, asin FROM shelf WHERE snapshot_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-01' AND lower(brand) = lower('{TARGET}') ORDER BY snapshot_date DESC, category_id, rank LIMIT 1000")
add("snapshot_stats", V.shelf, lambda s: s.agg(F.count("*").alias("rows"), F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last"), F.count_distinct("snapshot_date").alias("days")),
    "SELECT count(*) AS rows, min(snapshot_date) AS first, max(snapshot_date) AS last, count(DISTINCT snapshot_date) AS days FROM shelf")
add("distinct_dates", V.shelf, lambda s: s.select("snapshot_date").distinct(), "SELECT DISTINCT snapshot_date FROM shelf")
SOS = "SELECT snapshot_date, category_id, brand, count(*) AS products, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY snapshot_date, category_id) AS sos FROM shelf GROUP BY 1, 2, 3"
add("sos_by_brand", V.shelf, S.share_of_shelf, SOS, "sos")
add("market_position", V.shelf, lambda s: G.market_position(S.share_of_shelf(s)).select("snapshot_date", "category_id", "brand", "position"),
    f"SELECT snapshot_date, category_id, brand, CASE WHEN sos >= 0.30 THEN 'dominant' WHEN sos >= 0.15 THEN 'strong' ELSE 'niche' END AS position FROM ({SOS})")
HHI = "SELECT {k}, sum(s * s) * {m} AS hhi FROM (SELECT {k}, brand, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY {k}) AS s FROM shelf GROUP BY {k}, brand) GROUP BY {k}"
add("hhi_by_category", V.shelf, S.concentration, HHI.format(k="snapshot_date, category_id", m=1), "hhi")
add("hhi_points_daily", V.shelf, lambda s: S.concentration(s, ["snapshot_date"], 10000.0, "both"), HHI.format(k="snapshot_date", m=10000), "hhi")
add("hhi_label", V.shelf, lambda s: P.concentration_label(S.concentration(s, ["snapshot_date"], 10000.0, "both")), "SELECT avg(hhi) AS avg_hhi, CASE WHEN avg(hhi) < 1500 THEN 'competitive' WHEN avg(hhi) < 2500 THEN 'moderate' ELSE 'concentrated' END AS label FROM (" + HHI.format(k="snapshot_date", m=10000) + ")", "avg_hhi")
add("hhi_kept_unknown", V.shelf, lambda s: S.concentration(s, ["category_id"], 1.0, "keep"), HHI.format(k="category_id", m=1), "hhi")
add("brand_metrics", V.shelf, S.brand_metrics, """SELECT snapshot_date, category_id, brand, count(*) AS products, count(*)::DOUBLE / max(n) AS sos, avg(rank) AS avg_rank, min(rank) AS best_rank,
  count(*) FILTER (rank <= 10) AS top10, count(*) FILTER (rank <= 20) AS top20, 100 * (sum(pq)::DOUBLE / count(pq) / 1e6) / (max(mp)::DOUBLE / max(mpc) / 1e6) AS cpi, sum(rq)::DOUBLE / count(rq) / 1e6 - max(mr)::DOUBLE / max(mrc) / 1e6 AS rating_gap
  FROM (SELECT *, count(*) OVER w AS n, sum(pq) OVER w AS mp, count(pq) OVER w AS mpc, sum(rq) OVER w AS mr, count(rq) OVER w AS mrc FROM (SELECT *, CASE WHEN price > 0 THEN floor(price * 1e6 + 0.5)::BIGINT END AS pq, CASE WHEN rating > 0 THEN floor(rating * 1e6 + 0.5)::BIGINT END AS rq FROM shelf) WINDOW w AS (PARTITION BY snapshot_date, category_id)) GROUP BY 1, 2, 3""", "sos avg_rank cpi rating_gap")
CHURN = """WITH d AS (SELECT *, lag(snapshot_date) OVER (PARTITION BY category_id ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date, category_id FROM shelf)),
  e AS (SELECT d.snapshot_date, d.category_id, d.before, s.asin, 1 AS t, 0 AS y FROM d JOIN shelf s USING (snapshot_date, category_id)
        UNION ALL SELECT d.snapshot_date, d.category_id, d.before, s.asin, 0, 1 FROM d JOIN shelf s ON s.category_id = d.category_id AND s.snapshot_date = d.before),
  f AS (SELECT snapshot_date, category_id, asin, max(t) AS t, max(y) AS y, any_value(before) AS before FROM e GROUP BY 1, 2, 3)
  SELECT snapshot_date, category_id, count(*) FILTER (y = 0 AND before IS NOT NULL) AS entered, count(*) FILTER (t = 0) AS "left",
  (count(*) FILTER (y = 0 AND before IS NOT NULL) + count(*) FILTER (t = 0)) / 200.0::DOUBLE AS churn_rate FROM f GROUP BY 1, 2"""
add("churn_rate", V.shelf, S.churn, CHURN, "churn_rate")
HIST = """SELECT snapshot_date, category_id, asin, brand, rank, price, rating, rank - lag(rank) OVER h AS rank_change, rank - lag(rank, 7) OVER h AS rank_change_7,
  coalesce(abs(rank - lag(rank) OVER h) >= 5, false) AS rank_shock, CASE WHEN count(*) OVER l >= 2 THEN stddev_pop(rank) OVER l END AS volatility,
  CASE WHEN count(*) OVER l >= 2 THEN regr_slope(CASE WHEN rating > 0 THEN rating END, idx) OVER l END AS rating_trend,
  sum((rank <= 10)::INT) OVER (PARTITION BY category_id, asin, miss ORDER BY snapshot_date) AS streak, min(rank) OVER h AS best_rank, max(rank) OVER l - min(rank) OVER l AS rank_range
  FROM (SELECT *, row_number() OVER h0 AS idx, sum((rank > 10)::INT) OVER h0 AS miss FROM shelf WINDOW h0 AS (PARTITION BY category_id, asin ORDER BY snapshot_date))
  WINDOW h AS (PARTITION BY category_id, asin ORDER BY snapshot_date), l AS (PARTITION BY category_id, asin ORDER BY snapshot_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
for name, keep in (("rank_change", "rank_change"), ("rank_change_7", "rank_change_7"), ("rank_shock", "rank_shock"), ("streak_days", "streak"), ("best_rank", "best_rank"), ("rank_range", "rank_range")):
    add(name, V.shelf, lambda s, k=keep: S.product_history(s).select("snapshot_date", "category_id", "asin", k), f"SELECT snapshot_date, category_id, asin, {keep}{'::BIGINT AS streak' if keep == 'streak' else ''} FROM ({HIST})")
add("rank_volatility", V.shelf, lambda s: S.product_history(s).select("snapshot_date", "category_id", "asin", "volatility"), f"SELECT snapshot_date, category_id, asin, volatility FROM ({HIST})", "volatility")
add("rating_trend", V.shelf, lambda s: S.product_history(s.where("rating > 0")).select("snapshot_date", "category_id", "asin", "rating_trend"), f"SELECT snapshot_date, category_id, asin, rating_trend FROM ({HIST.replace('FROM shelf', 'FROM shelf WHERE rating > 0')})", "rating_trend")
add("days_in_top_n", V.shelf, S.days_in_top, "SELECT category_id, asin, " + ", ".join(f"count(*) FILTER (rank <= {t}) AS top{t}" for t in S.TIERS) + ", min(rank) AS best_rank FROM shelf GROUP BY 1, 2")
add("market_metrics", V.shelf, S.market_metrics, """SELECT snapshot_date, category_id, sum((c / n) * (c / n)) AS hhi, max(brand) FILTER (place = 1) AS top_brand, max(c / n) FILTER (place = 1) AS top_share, sum(p)::DOUBLE / sum(c) / 1e6 AS avg_price, sum(r)::DOUBLE / sum(c) / 1e6 AS avg_rating, (max(r / c) - min(r / c)) / 1e6 AS rating_spread
  FROM (SELECT *, sum(c) OVER (PARTITION BY snapshot_date, category_id) AS n, row_number() OVER (PARTITION BY snapshot_date, category_id ORDER BY c DESC, brand) AS place
        FROM (SELECT snapshot_date, category_id, brand, count(*)::DOUBLE AS c, sum(floor(price * 1e6 + 0.5)::BIGINT)::DOUBLE AS p, sum(floor(rating * 1e6 + 0.5)::BIGINT)::DOUBLE AS r FROM shelf GROUP BY 1, 2, 3)) GROUP BY 1, 2""", "hhi top_share avg_price avg_rating rating_spread")
ALERTS = f"""SELECT snapshot_date, category_id, asin, 'rank_drop' AS alert, CASE WHEN rank_change >= 10 THEN 'critical' ELSE 'warning' END AS severity FROM ({HIST}) WHERE rank_change >= 5
  UNION ALL SELECT snapshot_date, category_id, asin, 'top10_entry', 'info' FROM ({HIST}) WHERE rank <= 10 AND rank - rank_change > 10
  UNION ALL SELECT snapshot_date, category_id, asin, 'rank_shock', 'warning' FROM ({HIST}) WHERE rank_shock"""
add("metric_alerts", V.shelf, lambda s: S.metric_alerts(S.product_history(s)), ALERTS)
add("alert_summary", V.shelf, lambda s: S.metric_alerts(S.product_history(s)).groupBy("alert", "severity").agg(F.count("*").alias("n")), f"SELECT alert, severity, count(*) AS n FROM ({ALERTS}) GROUP BY 1, 2")

IS = f"(upper(brand) LIKE '%{TARGET.upper()}%' OR upper(product_name) LIKE '%{TARGET.upper()}%')"
DAILY = f"SELECT snapshot_date, count(*) FILTER ({IS})::DOUBLE / count(*) AS sos FROM shelf GROUP BY 1"
add("target_profile", V.shelf, lambda s: P.target_profile(s, TARGET), f"SELECT avg(sos) AS avg_sos, min_by(sos, snapshot_date) AS start_sos, max_by(sos, snapshot_date) AS end_sos, count(*) AS days, max_by(sos, snapshot_date) - min_by(sos, snapshot_date) AS change, CASE WHEN min_by(sos, snapshot_date) > 0 THEN 100 * (max_by(sos, snapshot_date) - min_by(sos, snapshot_date)) / min_by(sos, snapshot_date) END AS change_percent FROM ({DAILY})", "avg_sos start_sos end_sos change change_percent")
MOVES = "SELECT category_id, asin, min_by(rank, snapshot_date) AS start_rank, max_by(rank, snapshot_date) AS end_rank, count(*) AS seen, max(brand) AS brand, min_by(rank, snapshot_date) - max_by(rank, snapshot_date) AS move FROM shelf GROUP BY 1, 2 HAVING count(*) >= 2"
add("product_moves", V.shelf, P.product_moves, MOVES)
add("top_movers", V.shelf, P.movers, f"(SELECT *, 'riser' AS kind FROM ({MOVES}) WHERE move > 5 ORDER BY move DESC, category_id, asin LIMIT 10) UNION ALL (SELECT *, 'faller' FROM ({MOVES}) WHERE move < -5 ORDER BY move, category_id, asin LIMIT 10)")
add("brand_performance", V.shelf, P.brand_performance, """SELECT brand, sum(s) / max(days) AS avg_sos, coalesce(max(s) FILTER (snapshot_date = first), 0) AS start_sos, coalesce(max(s) FILTER (snapshot_date = last), 0) AS end_sos, sum(c) / max(days) AS avg_products, count(*) AS appearances,
  coalesce(max(s) FILTER (snapshot_date = last), 0) - coalesce(max(s) FILTER (snapshot_date = first), 0) AS change
  FROM (SELECT *, c / sum(c) OVER (PARTITION BY snapshot_date) AS s FROM (SELECT snapshot_date, brand, count(*)::DOUBLE AS c FROM shelf GROUP BY 1, 2)) CROSS JOIN (SELECT count(DISTINCT snapshot_date)::DOUBLE AS days, min(snapshot_date) AS first, max(snapshot_date) AS last FROM shelf)
  GROUP BY 1 ORDER BY round(avg_sos, 9) DESC, brand LIMIT 20""", "avg_sos start_sos end_sos avg_products change")
add("competitive_shifts", V.shelf, P.competitive_shifts, """SELECT category_id, brand, CASE WHEN f = 1 THEN 'exited' ELSE 'entered' END AS shift FROM (SELECT category_id, brand, max((snapshot_date = lo)::INT) AS f, max((snapshot_date = hi)::INT) AS l
  FROM (SELECT *, min(snapshot_date) OVER (PARTITION BY category_id) AS lo, max(snapshot_date) OVER (PARTITION BY category_id) AS hi FROM shelf) WHERE snapshot_date IN (lo, hi) GROUP BY 1, 2) WHERE f <> l""")
add("daily_trends", V.shelf, lambda s: P.daily_trends(s, TARGET), f"SELECT snapshot_date, sum(t) / sum(c) AS sos, sum(c)::BIGINT AS products, count(*) AS brand_count, sum(c / n * c / n) * 10000 AS hhi FROM (SELECT *, sum(c) OVER (PARTITION BY snapshot_date) AS n FROM (SELECT snapshot_date, brand, count(*)::DOUBLE AS c, count(*) FILTER ({IS}) AS t FROM shelf GROUP BY 1, 2)) GROUP BY 1", "sos hhi")
add("category_kpi", V.shelf, lambda s: P.category_kpi(s, TARGET), f"SELECT category_id, count(*) FILTER ({IS})::DOUBLE / count(*) AS sos, coalesce(min(rank) FILTER ({IS}), 999) AS best_rank, coalesce(100 * avg(price) FILTER ({IS}) / avg(price), 100) AS cpi, count(*) FILTER ({IS}) AS own_products, count(DISTINCT brand) AS brands FROM shelf WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf) GROUP BY 1", "sos cpi")
add("sos_by_category", V.shelf, P.sos_by_category, "SELECT category_id, brand, count(*)::DOUBLE / max(n) AS sos, count(DISTINCT snapshot_date) AS appeared, count(DISTINCT snapshot_date)::DOUBLE / max(days) AS appearance_rate FROM shelf JOIN (SELECT category_id, count(DISTINCT snapshot_date) AS days, count(*) AS n FROM shelf GROUP BY 1) USING (category_id) GROUP BY 1, 2", "sos appearance_rate")
add("available_brands", V.shelf, P.available_brands, "SELECT brand, count(DISTINCT asin) AS products, count(DISTINCT snapshot_date) AS days FROM shelf GROUP BY 1 HAVING count(DISTINCT asin) >= 3")
add("sos_trend", V.shelf, lambda s: P.sos_trend(s, TARGET), f"SELECT snapshot_date, count(*) FILTER (lower(brand) LIKE '%{TARGET.lower()}%') AS own, count(*) AS total, count(*) FILTER (lower(brand) LIKE '%{TARGET.lower()}%')::DOUBLE / count(*) AS sos FROM shelf GROUP BY 1", "sos")
add("competitor_avg_sos", V.shelf, lambda s: P.competitor_avg_sos(s, TARGET), f"SELECT snapshot_date, avg(s) AS avg_sos, count(*) AS brands FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY c DESC, brand) AS place FROM (SELECT *, c / sum(c) OVER (PARTITION BY snapshot_date) AS s FROM (SELECT snapshot_date, brand, count(*)::DOUBLE AS c FROM shelf GROUP BY 1, 2)) WHERE lower(brand) NOT LIKE '%{TARGET.lower()}%') WHERE place <= 5 GROUP BY 1", "avg_sos")
add("period_brand_metrics", V.shelf, lambda s: P.period_brand_metrics(s, TARGET), f"SELECT brand, products, avg_rank, avg_price, products::DOUBLE / (SELECT greatest(count(DISTINCT asin), 100) FROM shelf) AS share FROM (SELECT *, row_number() OVER (ORDER BY products DESC, brand) AS place FROM (SELECT brand, count(DISTINCT asin) AS products, avg(rank) AS avg_rank, avg(price) AS avg_price FROM shelf GROUP BY 1)) WHERE place <= 10 OR brand = '{TARGET}'", "avg_rank avg_price share")
add("action_items", V.shelf, lambda s: P.action_items(S.product_history(s)), f"""SELECT asin, category_id, rank, coalesce(rank_change, 0) AS change, CASE WHEN coalesce(rank_change, 0) >= 10 THEN 'sharp_drop' WHEN coalesce(rank_change, 0) <= -10 THEN 'sharp_rise' WHEN rank <= 5 THEN 'leader' WHEN rank <= 20 THEN 'contender' ELSE 'watch' END AS signal,
  CASE WHEN rank <= 5 THEN 'P1' WHEN rank <= 20 THEN 'P2' ELSE 'P3' END AS priority FROM ({HIST}) WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf) QUALIFY row_number() OVER (PARTITION BY asin ORDER BY rank, category_id) = 1""")
add("product_view", V.shelf, lambda s: P.product_view(S.product_history(s)), f"""SELECT category_id, asin, rank, CASE WHEN v < 3 THEN 'stable' WHEN v < 10 THEN 'moving' ELSE 'volatile' END AS band, CASE WHEN rank <= 10 AND v < 15 THEN 'steady leader' WHEN rank <= 10 THEN 'shaky leader' WHEN v < 15 THEN 'steady follower' ELSE 'shaky follower' END AS quadrant
  FROM (SELECT *, coalesce(volatility, 0) AS v FROM ({HIST}) QUALIFY row_number() OVER (PARTITION BY category_id, asin ORDER BY snapshot_date DESC) = 1)""")
add("product_share", V.shelf, P.product_share, "SELECT category_id, product, weight::BIGINT AS weight, weight / sum(weight) OVER (PARTITION BY category_id) AS share FROM (SELECT category_id, CASE WHEN rank <= 5 THEN asin::VARCHAR ELSE 'Others' END AS product, sum(greatest(1, 100 - rank))::DOUBLE AS weight FROM shelf WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf) GROUP BY 1, 2)", "share")
add("brand_matrix", V.shelf, P.brand_matrix, "SELECT brand, count(*) AS products, avg(rank) AS avg_rank, avg(rating) AS avg_rating FROM shelf GROUP BY 1 HAVING count(*) >= 2 ORDER BY products DESC, brand LIMIT 10", "avg_rank avg_rating")
add("recent_sos_trend", V.shelf, lambda s: P.recent_trend(s, TARGET), f"SELECT * FROM ({DAILY}) ORDER BY snapshot_date DESC LIMIT 14", "sos")
#: The months of the supplied tables.
MONTHS = [f"{y}{m:02d}" for y in range(1995, 2002) for m in range(1, 13)][:83]
add("rank_series_pivot", V.shelf, P.rank_series, "SELECT asin, " + ", ".join(f"min(rank) FILTER (strftime(snapshot_date, '%Y%m') = '{m}') AS r{m}" for m in MONTHS) + " FROM shelf GROUP BY 1")
add("discount_trend", V.shelf, P.discount_trend, "SELECT snapshot_date, category_id, avg(discount_percent) AS avg_discount, min_by(discount_percent, rank) AS best_product_discount, max(discount_percent) AS max_discount FROM shelf GROUP BY 1, 2", "avg_discount best_product_discount max_discount")
add("growth_types", V.shelf, lambda s: P.growth_types(s, 5.0), "SELECT category_id, CASE WHEN discount_percent > 5 THEN 'promotion' ELSE 'organic' END AS growth, count(*) AS rows FROM shelf GROUP BY 1, 2")
add("duplicate_groups", V.shelf, lambda s: P.duplicate_groups(s.union(s.where("rank <= 3"))), "SELECT snapshot_date, asin, category_id, 2::BIGINT AS n FROM shelf WHERE rank <= 3")
add("grouping_report", V.shelf, P.grouping_report, "SELECT category_id, brand, count(*) AS rows, min(rank) AS best_rank, grouping(category_id, brand) AS level FROM shelf GROUP BY CUBE (category_id, brand)")
add("rank_surges", V.shelf, P.surges, "SELECT snapshot_date, category_id, asin, rank, gain FROM (SELECT *, lag(rank, 3) OVER (PARTITION BY category_id, asin ORDER BY snapshot_date) - rank AS gain FROM shelf) WHERE gain >= 20")
add("frequent_products", V.shelf, lambda s: P.frequent(s, 36, 3, 30), "SELECT category_id, asin, count(*) AS seen FROM shelf WHERE rank <= 30 AND snapshot_date IN (SELECT DISTINCT snapshot_date FROM shelf ORDER BY 1 DESC LIMIT 36) GROUP BY 1, 2 HAVING count(*) >= 3")
add("promoted_gains", V.shelf, lambda s: P.promoted_gains(s, 8.0), "SELECT snapshot_date, category_id, asin, gain FROM (SELECT *, lag(rank) OVER (PARTITION BY category_id, asin ORDER BY snapshot_date) - rank AS gain FROM shelf) WHERE gain >= 10 AND discount_percent >= 8")
add("presence_check", V.shelf, lambda s: P.presence(s.where("rank <= 50"), s.where("category_id like 'S%'")), "SELECT snapshot_date, count(*) FILTER (rank <= 50) AS left_rows, count(*) FILTER (category_id LIKE 'S%') AS right_rows FROM shelf GROUP BY 1")
add("missing_dates", V.shelf, lambda s: s.select("snapshot_date").distinct().join(s.where("month(snapshot_date) <> 2").select("snapshot_date").distinct(), "snapshot_date", "left_anti"), "SELECT DISTINCT snapshot_date FROM shelf WHERE month(snapshot_date) = 2")
add("upsert_latest", V.shelf, lambda s: P.upsert(s.select("snapshot_date", "category_id", "asin", "rank"), s.where("rank <= 5").select("snapshot_date", "category_id", "asin", (F.col("rank") + 1).alias("rank")), ["snapshot_date", "category_id", "asin"]), "SELECT snapshot_date, category_id, asin, CASE WHEN rank <= 5 THEN rank + 1 ELSE rank END AS rank FROM shelf")
add("insert_if_absent", V.shelf, lambda s: P.insert_absent(s.where("rank <= 5").groupBy("asin").agg(F.min("rank").alias("rank")), s.groupBy("asin").agg(F.lit(0).alias("rank")), ["asin"]), "SELECT asin, coalesce(min(rank) FILTER (rank <= 5), 0) AS rank FROM shelf GROUP BY 1")

add("deals_by_brand", V.deals, D.by_brand, "SELECT brand, count(*) AS deals, count(*) FILTER (deal_type = 'lightning') AS lightning, avg(discount_percent) AS avg_discount, max(discount_percent) AS max_discount, count(DISTINCT asin) AS products FROM deals GROUP BY 1 ORDER BY deals DESC, brand LIMIT 20", "avg_discount")
add("deals_by_date", V.deals, D.by_date, "SELECT CAST(snapshot_datetime AS DATE) AS day, count(*) AS deals, count(DISTINCT brand) AS brands, avg(discount_percent) AS avg_discount FROM deals GROUP BY 1", "avg_discount")
LATEST = "SELECT snapshot_datetime, asin, brand, max(discount_percent) AS discount_percent FROM deals {w} GROUP BY 1, 2, 3 ORDER BY snapshot_datetime DESC, asin LIMIT {k}"
add("competitor_deals_latest", V.deals, lambda d: D.latest(d, None, 500), LATEST.format(w="", k=500))
add("lightning_deals_latest", V.deals, lambda d: D.latest(d, "lightning"), LATEST.format(w="WHERE deal_type = 'lightning'", k=200))
add("deal_alerts", V.deals, lambda d: D.alert_classes(d, deep=9), "SELECT brand, CASE WHEN deal_type = 'lightning' THEN 'lightning' WHEN discount_percent >= 9 THEN 'deep' WHEN deal_type = 'deal_of_day' THEN 'day' ELSE 'discount' END AS alert, count(*) AS alerts FROM deals WHERE deal_type IN ('lightning', 'deal_of_day') OR discount_percent >= 5 GROUP BY 1, 2")

add("kg_match", V.triples, lambda t: G.match(t, predicate="belongsToCategory", least=0.5).groupBy("object").agg(F.count("*").alias("n")), "SELECT object, count(*) AS n FROM triples WHERE predicate = 'belongsToCategory' GROUP BY 1")
add("kg_neighbours", V.triples, lambda t: G.neighbours(t, "EUROPE"), "SELECT predicate, object AS neighbour, 'out' AS direction FROM triples WHERE subject = 'EUROPE' UNION ALL SELECT predicate, subject, 'in' FROM triples WHERE object = 'EUROPE'")
add("kg_pattern_join", V.triples, lambda t: G.pattern(t, [("?brand", "hasProduct", "?product"), ("?product", "belongsToCategory", "?category")], ["brand", "category", "product"]), "SELECT a.subject AS brand, b.object AS category, a.object AS product FROM triples a JOIN triples b ON a.object = b.subject WHERE a.predicate = 'hasProduct' AND b.predicate = 'belongsToCategory'")
add("kg_pattern_filter", V.triples, lambda t: G.pattern(t, [("?a", "directCompetitor", "?b"), ("?b", "directCompetitor", "?c")], ["a", "b", "c"], ["a <> c", "a < 'Brand#3'"]), "SELECT x.subject AS a, x.object AS b, y.object AS c FROM triples x JOIN triples y ON x.object = y.subject WHERE x.predicate = 'directCompetitor' AND y.predicate = 'directCompetitor' AND x.subject <> y.object AND x.subject < 'Brand#3'")
add("kg_bfs", V.triples, lambda t: G.levels(t, "EUROPE", 3), """SELECT entity, min(depth) AS depth FROM (WITH RECURSIVE b AS (SELECT DISTINCT subject AS s, object AS o FROM triples UNION SELECT object, subject FROM triples), r AS (SELECT 'EUROPE' AS entity, 0 AS depth UNION SELECT o, depth + 1 FROM r JOIN b ON s = entity WHERE depth < 3) SELECT * FROM r) GROUP BY 1""")
add("kg_path", V.triples, lambda t: G.shortest_paths(t, "Brand#11", "Brand#23", 3), """SELECT path, hops FROM (WITH RECURSIVE e AS (SELECT DISTINCT subject, object FROM triples WHERE predicate <> 'belongsToCategory'), r AS (SELECT 'Brand#11' AS here, 'Brand#11' AS path, 0 AS hops UNION SELECT object, path || '>' || object, hops + 1 FROM r JOIN e ON subject = here WHERE hops < 3 AND object LIKE 'Brand%' AND NOT contains(path, object)) SELECT * FROM r) WHERE here = 'Brand#23' ORDER BY hops, path LIMIT 1""")
DEG = "SELECT entity, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT subject AS entity, 1 AS o, 0 AS i FROM triples UNION ALL SELECT object, 0, 1 FROM triples) GROUP BY 1"
add("kg_degree", V.triples, G.degrees, DEG)
add("kg_most_connected", V.triples, lambda t: G.degrees(t, 10), DEG + " ORDER BY degree DESC, entity LIMIT 10")
add("kg_stats", V.triples, G.stats, "SELECT predicate, count(*) AS edges, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects, avg(confidence) AS avg_confidence FROM triples GROUP BY 1", "avg_confidence")
CB = "SELECT b.object AS category, a.subject AS brand, count(*) AS products FROM triples a JOIN triples b ON a.object = b.subject WHERE a.predicate = 'hasProduct' AND b.predicate = 'belongsToCategory' GROUP BY 1, 2"
add("kg_category_brands", V.triples, G.category_brands, CB + " HAVING count(*) >= 2")
add("competitor_edges", V.triples, G.competitors, "SELECT subject, object, CASE WHEN min(k) = 1 THEN 'direct' ELSE 'indirect' END AS kind FROM (SELECT subject, object, CASE WHEN predicate = 'directCompetitor' THEN 1 ELSE 2 END AS k FROM triples WHERE predicate LIKE '%Competitor' UNION ALL SELECT object, subject, CASE WHEN predicate = 'directCompetitor' THEN 1 ELSE 2 END FROM triples WHERE predicate LIKE '%Competitor') GROUP BY 1, 2")
add("kg_merge", V.triples, lambda t: G.merged(t.union(t.where("confidence < 1").withColumn("confidence", F.lit(0.95)))), "SELECT subject, predicate, object, CASE WHEN confidence < 1 THEN 0.95 ELSE confidence END AS confidence, CASE WHEN confidence < 1 THEN 2 ELSE 1 END::BIGINT AS times FROM triples")
add("kg_dominance", V.triples, lambda t: G.dominance(t, 0.05), f"SELECT category, brand, products::DOUBLE / n AS share, least(1, products::DOUBLE / n + 0.5) AS confidence FROM (SELECT *, sum(products) OVER (PARTITION BY category) AS n FROM ({CB})) WHERE products::DOUBLE / n >= 0.05", "share confidence")
add("price_position", V.shelf, lambda s: G.price_position(s.select(F.col("category_id").alias("category"), "brand", "price")), "SELECT category, brand, ratio, CASE WHEN ratio >= 1.3 THEN 'premium' WHEN ratio <= 0.7 THEN 'value' ELSE 'mid' END AS position FROM (SELECT category_id AS category, brand, avg(price) / max(m) AS ratio FROM (SELECT *, avg(price) OVER (PARTITION BY category_id) AS m FROM shelf) GROUP BY 1, 2)", "ratio")
add("kg_importance", V.triples, G.importance, "SELECT score, count(*) AS n FROM (SELECT DISTINCT *, 0.5::DOUBLE + CASE WHEN predicate = 'hasProduct' THEN 10 ELSE 0 END + 2 * confidence + CASE WHEN predicate IN ('directCompetitor', 'belongsToCategory') THEN 1 ELSE 0 END AS score FROM triples) GROUP BY 1", "score")
add("kg_eviction", V.triples, G.eviction, "SELECT score, n, greatest(0, least(n, floor(sum(n) OVER () * 0.1::DOUBLE) - coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS evicted FROM (SELECT score, count(*) AS n FROM (SELECT DISTINCT *, 0.5::DOUBLE + CASE WHEN predicate = 'hasProduct' THEN 10 ELSE 0 END + 2 * confidence + CASE WHEN predicate IN ('directCompetitor', 'belongsToCategory') THEN 1 ELSE 0 END AS score FROM triples) GROUP BY 1)", "score")
add("kg_ancestors", V.triples, lambda t: G.ancestors(t, ("originatesFrom", "parentCategory")), "SELECT subject AS entity, object AS ancestor, 1 AS steps FROM triples WHERE predicate IN ('originatesFrom', 'parentCategory') UNION ALL SELECT a.subject, b.object, 2 FROM triples a JOIN triples b ON a.object = b.subject WHERE a.predicate = 'originatesFrom' AND b.predicate = 'parentCategory'")
VALID = " OR ".join(f"(predicate = '{p}' AND sk IN ('{s}', 'entity') AND ok IN ('{o}', 'entity'))" for s, p, o in G.ALLOWED)
KIND = "CASE WHEN regexp_matches({c}, '^P[0-9]+$') THEN 'product' WHEN {c} LIKE 'Brand%' THEN 'brand' WHEN {c} LIKE 'Supplier%' THEN 'supplier' ELSE 'entity' END"
add("kg_validate", V.triples, G.validated, f"SELECT predicate, sk, ok, n, ({VALID}) AS valid FROM (SELECT predicate, {KIND.format(c='subject')} AS sk, {KIND.format(c='object')} AS ok, count(*) AS n FROM triples GROUP BY 1, 2, 3)")
add("run_sessions", V.runs, lambda r: r.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors")), "SELECT user_id, session, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM runs GROUP BY 1, 2")
add("run_success_rate", V.runs, lambda r: r.groupBy("event_type").agg(F.count("*").alias("runs"), F.avg("value").alias("mean_value"), F.count_distinct("user_id").alias("users"), F.avg((F.col("value") <= 50).cast("double")).alias("success_rate")), "SELECT event_type, count(*) AS runs, avg(value) AS mean_value, count(DISTINCT user_id) AS users, avg((value <= 50)::INT::DOUBLE) AS success_rate FROM runs GROUP BY 1", "mean_value success_rate")

#: Dates leave as text, so that no reader's date type changes a value.
DATED = {"snapshot_stats": ("first", "last"), "deals_by_date": ("day",)}
DATED |= dict.fromkeys(
    """shelf_snapshot latest_snapshot filtered_scan distinct_dates sos_by_brand market_position hhi_by_category hhi_points_daily brand_metrics churn_rate rank_change rank_change_7 rank_shock
    streak_days best_rank rank_range rank_volatility rating_trend market_metrics metric_alerts daily_trends sos_trend competitor_avg_sos recent_sos_trend discount_trend duplicate_groups
    rank_surges promoted_gains presence_check missing_dates upsert_latest""".split(),
    ("snapshot_date",),
)


def _as_text(plan, names):
    return lambda spark, sf: plan(spark, sf).withColumns({n: F.col(n).cast("string") for n in names})


for name, names in DATED.items():
    QUERIES[name] = _as_text(QUERIES[name], names)
    SQL[name] = f"SELECT * REPLACE ({', '.join(f'CAST({n} AS VARCHAR) AS {n}' for n in names)}) FROM ({SQL[name]})"
