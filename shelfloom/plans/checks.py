"""Queries over claims in reports, action ladders and summaries, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfloom.operators import claims as C
from shelfloom.operators import dashboard as D
from shelfloom.operators import shelf as S
from shelfloom.sources import views as V

from . import analytics as A

QUERIES: dict = {}
SQL: dict = {}


def add(name, plan, sql, doubles=""):
    """Register a plan over (spark, folder); doubles are rounded to 6 digits on both sides."""
    cols = doubles.split()
    QUERIES[name] = lambda spark, sf: plan(spark, sf).withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in cols})
    with_, sep, body = sql.partition("\n--\n")
    body = body or with_
    body = f"SELECT * REPLACE ({', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in cols)}) FROM ({body})" if cols else body
    SQL[name] = f"{with_} {body}" if sep else body


# --- claims: reports about orders

_REPORT = [
    "순위: {a} → {b}", "SoS: {c}.5% TOP {a}", "HHI: {d}", "{a}위에서 {b}위로, 전주 대비 {c}% 증가", "Summer mask, Tower 28 and 지난 주 2024-03-{a}", "Unknown 경쟁력 높음 ${c}.25, {b}개, 평균보다 높은 {a}배",
]


def reports(s, d):
    """One sentence an order, by its number."""
    k = F.col("o_orderkey")
    figures = {"a": k % 19 + 10, "b": k % 83, "c": k % 97, "d": k % 13 * 1000}
    out = F.lit(None).cast("string")
    for i, line in enumerate(_REPORT):
        for name, value in figures.items():
            line = line.replace("{" + name + "}", f"\0{name}\0")
        parts = [figures[p].cast("string") if p in figures else F.lit(p) for p in line.split("\0") if p]
        out = F.when(k % len(_REPORT) == i, F.concat(*parts)).otherwise(out)
    return V.table(s, d, "orders").select("o_orderkey", out.alias("text"))


def _sentence(line):
    for name, value in {"a": "(o_orderkey % 19 + 10)", "b": "(o_orderkey % 83)", "c": "(o_orderkey % 97)", "d": "(o_orderkey % 13 * 1000)"}.items():
        line = line.replace("{" + name + "}", f"' || {value} || '")
    return f"'{line}'"


REPORTS = "(SELECT o_orderkey, CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {_sentence(x)}" for i, x in enumerate(_REPORT)) + " END AS text FROM orders)"
add("report_claims", lambda s, d: C.extract(reports(s, d), list(C.REPORT_PATTERNS), "o_orderkey", patterns=C.REPORT_PATTERNS).select("o_orderkey", "kind", "number", "claim"),
    " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS kind, unnest(range(len(l)))::INT AS number, unnest(l) AS claim FROM (SELECT o_orderkey, regexp_extract_all(text, '{p}') AS l FROM {REPORTS})" for k, p in C.REPORT_PATTERNS.items()))
add("report_issues", lambda s, d: reports(s, d).select("o_orderkey", F.array_join(C.report_issues(F.col("text")), ",").alias("issues")),
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN abs(o_orderkey % 19 + 10 - o_orderkey % 83) > 30 THEN 'rank_jump' ELSE '' END WHEN 1 THEN CASE WHEN o_orderkey % 97 + 0.5 > 50 THEN 'share_above_limit' ELSE '' END WHEN 2 THEN CASE WHEN o_orderkey % 13 * 1000 > 10000 THEN 'concentration_above_limit' ELSE '' END
    WHEN 3 THEN CASE WHEN abs(o_orderkey % 19 + 10 - o_orderkey % 83) > 30 THEN 'rank_jump' ELSE '' END WHEN 4 THEN 'shortened_brand' ELSE 'unknown_brand' END AS issues FROM orders""")


def _ranks(s, d):
    i = V.table(s, d, "lineitem")
    x = C.rank_status(F.col("l_linenumber"), F.when(F.col("l_quantity") < 40, F.col("l_quantity").cast("long") % 8))
    kind = F.when(F.col("l_returnflag") == "R", "numerical").when(F.col("l_returnflag") == "A", "comparative").otherwise("logical")
    return i.select("l_orderkey", kind.alias("kind"), x.alias("x")).select("l_orderkey", "kind", "x.*")


_STATUS = """(SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'numerical' WHEN 'A' THEN 'comparative' ELSE 'logical' END AS kind, CASE WHEN l_quantity >= 40 THEN 'unknown' WHEN l_linenumber = l_quantity::BIGINT % 8 THEN 'verified' WHEN abs(l_linenumber - l_quantity::BIGINT % 8) <= 1 THEN 'close' ELSE 'refuted' END AS status FROM lineitem)"""
add("rank_claims", lambda s, d: _ranks(s, d).groupBy("kind", "status", "confidence").agg(F.count("*").alias("claims")), f"SELECT kind, status, CASE status WHEN 'verified' THEN 1.0::DOUBLE WHEN 'close' THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS confidence, count(*) AS claims FROM {_STATUS} GROUP BY ALL")
_W = "CASE kind WHEN 'numerical' THEN 15 WHEN 'comparative' THEN 8 ELSE 12 END"
_POINTS = "CASE status WHEN 'verified' THEN 100 WHEN 'close' THEN 73 WHEN 'unknown' THEN 28 ELSE 0 END"
add("text_grades", lambda s, d: C.text_scores(_ranks(s, d), "l_orderkey").groupBy("grade").agg(F.count("*").alias("texts")),
    f"SELECT CASE WHEN score >= 0.85::DOUBLE THEN 'high' WHEN score >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS grade, count(*) AS texts FROM (SELECT l_orderkey, (20 * sum({_POINTS} * {_W}) + sum({_W})) // (2 * sum({_W})) / 1000.0::DOUBLE AS score FROM {_STATUS} GROUP BY 1) GROUP BY 1")


def _names(s, d):
    fact = lambda a, p, b: F.struct(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"))
    facts = F.array(fact(F.col("p_brand"), "hasProduct", F.col("p_name")), fact(F.col("p_name"), "belongsToCategory", F.col("p_type")), fact(F.col("p_type"), "hasProduct", F.lit("")))
    return V.table(s, d, "part").select("p_partkey", C.context_names(facts, 2).alias("x")).select("p_partkey", F.array_join("x.entities", ",").alias("entities"), F.array_join("x.relations", ",").alias("relations"))


add("context_names", _names, "SELECT p_partkey, list_aggregate(list_sort(list_distinct([p_brand, p_name, p_type]))[1:2], 'string_agg', ',') AS entities, 'belongsToCategory,hasProduct' AS relations FROM part")

# --- what to do, by product and category

add("action_ladder", lambda s, d: D.ladder(S.product_history(V.shelf(s, d))), f"""WITH {V.SHELF_SQL}, h AS ({A.HIST})
--
SELECT asin, category_id, rank, change, CASE WHEN change < -2 THEN 'rise' WHEN change > 2 THEN 'fall' WHEN rating > 0 AND rating < 4 THEN 'low_rating' WHEN rank_range > 15 THEN 'volatile' WHEN rank <= 5 THEN 'top' ELSE 'steady' END AS signal,
  CASE WHEN change < -2 THEN 'MONITOR' WHEN change > 2 OR (rating > 0 AND rating < 4) THEN 'CHECK' WHEN rank_range > 15 THEN 'DEEP DIVE' WHEN rank <= 5 THEN 'MONITOR' ELSE 'DEEP DIVE' END AS action, CASE WHEN abs(change) > 2 OR (rating > 0 AND rating < 4) OR rank_range > 15 THEN 'P1' ELSE 'P2' END AS priority
  FROM (SELECT *, coalesce(rank_change, 0) AS change FROM h WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf) QUALIFY row_number() OVER (PARTITION BY asin ORDER BY rank, category_id) = 1)""")


def _growth(s, d):
    kind = F.col("deal_type")
    return V.deals(s, d).groupBy("category", D.growth_type(F.col("discount_percent"), F.when(kind == "coupon", "5% coupon"), F.when(kind == "lightning", "Lightning").when(kind == "best_deal", ""), 7).alias("growth")).agg(F.count("*").alias("rows"))


add("growth_by_promotion", _growth, f"WITH {V.DEALS_SQL}\n--\nSELECT category, CASE WHEN discount_percent > 7 OR deal_type IN ('coupon', 'lightning') THEN 'discount_based' ELSE 'organic' END AS growth, count(*) AS rows FROM deals GROUP BY 1, 2")
add("brand_matrix_with_target", lambda s, d: D.matrix(V.shelf(s, d), A.TARGET, 3), f"WITH {V.SHELF_SQL}\n--\nSELECT brand, products, avg_rank FROM (SELECT brand, count(*) AS products, avg(rank) AS avg_rank FROM shelf GROUP BY 1) QUALIFY row_number() OVER (ORDER BY products DESC, brand) <= 3 OR brand = '{A.TARGET}'", "avg_rank")
add("run_summary", lambda s, d: (lambda h: D.run_summary(h, S.metric_alerts(S.product_history(h)), F.col("brand") == A.TARGET).withColumn("snapshot_date", F.col("snapshot_date").cast("string")))(V.shelf(s, d)), f"""WITH {V.SHELF_SQL}, a AS ({A.ALERTS}), l AS (SELECT * FROM shelf WHERE snapshot_date = (SELECT max(snapshot_date) FROM shelf)), n AS (SELECT snapshot_date, category_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM a GROUP BY 1, 2)
--
SELECT snapshot_date::VARCHAR AS snapshot_date, category_id, sos, best, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, coalesce(info, 0) AS info FROM (SELECT snapshot_date, category_id, count(*) FILTER (brand = '{A.TARGET}')::DOUBLE / count(*) AS sos, min_by(asin, rank) FILTER (brand = '{A.TARGET}') AS best FROM l GROUP BY 1, 2) LEFT JOIN n USING (snapshot_date, category_id)""", "sos")
