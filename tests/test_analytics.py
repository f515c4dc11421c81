"""Operators on hand-made rows, and plans that must keep their shape."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from shelfloom.functions import scalars as X
from shelfloom.operators import claims as C
from shelfloom.operators import evaluation as E
from shelfloom.operators import graph as G
from shelfloom.operators import period as P
from shelfloom.operators import retrieval as R
from shelfloom.operators import rules as N
from shelfloom.operators import shelf as S
from shelfloom.plans import registry
from shelfloom.sources import views as V
from shelfloom.streaming import monitor as M

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def shelf(spark, rows):
    """rows: (day offset, asin, brand, rank[, price, rating])"""
    full = [(DAY + dt.timedelta(r[0]), "c", r[1], f"name {r[1]}", r[2], r[4] if len(r) > 4 else 10.0, 10.0, 0.0, r[5] if len(r) > 5 else 4.0, 1, r[3]) for r in rows]
    return spark.createDataFrame(full, "snapshot_date date, category_id string, asin long, product_name string, brand string, price double, list_price double, discount_percent double, rating double, reviews_count long, rank int")


def test_hhi_known_values(spark):
    one = shelf(spark, [(0, i, "A", i + 1) for i in range(10)])
    many = shelf(spark, [(0, i, f"B{i}", i + 1) for i in range(100)])
    assert S.concentration(one).first().hhi == 1.0
    assert S.concentration(many).first().hhi == pytest.approx(0.01)
    mixed = shelf(spark, [(0, 1, "A", 1), (0, 2, "A", 2), (0, 3, "unknown", 3), (0, 4, None, 4)])
    assert S.concentration(mixed).first().hhi == pytest.approx(0.25)
    assert S.concentration(mixed, unknown="both").first().hhi == 1.0
    assert S.concentration(mixed, scale=10000.0, unknown="keep").first().hhi == pytest.approx(3750.0)


def test_shares_sum_to_one_and_missing_rank_is_outside(spark):
    rows = shelf(spark, [(0, 1, "A", 1), (0, 2, "B", 2), (0, 3, "C", None)])
    out = {r.brand: r.sos for r in S.share_of_shelf(rows).collect()}
    assert out == {"A": 0.5, "B": 0.5}


def test_brand_metrics_ignore_missing_prices(spark):
    rows = shelf(spark, [(0, 1, "A", 1, 20.0, 5.0), (0, 2, "A", 30, None, 0.0), (0, 3, "B", 15, 10.0, 3.0)])
    a = {r.brand: r for r in S.brand_metrics(rows).collect()}["A"]
    assert a.cpi == pytest.approx(100 * 20 / 15) and a.rating_gap == pytest.approx(1.0) and (a.top10, a.top20, a.best_rank) == (1, 1, 1)


def test_churn_counts_both_sides(spark):
    rows = shelf(spark, [(0, 1, "A", 1), (0, 2, "A", 2), (1, 2, "A", 1), (1, 3, "A", 2), (1, 4, "A", 3)])
    out = {r.snapshot_date: r for r in S.churn(rows, 10).collect()}
    assert out[DAY].churn_rate == 0.0
    later = out[DAY + dt.timedelta(1)]
    assert (later.entered, later.left, later.churn_rate) == (2, 1, 3 / 20)


def test_history_metrics(spark):
    ranks = [3, 9, 12, 8, 2]
    out = sorted(S.product_history(shelf(spark, [(i, 1, "A", r, 10.0, 4 + i / 10) for i, r in enumerate(ranks)])).collect(), key=lambda r: r.snapshot_date)
    assert [r.rank_change for r in out] == [None, 6, 3, -4, -6]
    assert [r.rank_shock for r in out] == [False, True, False, False, True]
    assert [r.streak for r in out] == [1, 2, 0, 1, 2]
    mean = sum(ranks) / 5
    assert out[-1].volatility == pytest.approx(math.sqrt(sum((r - mean) ** 2 for r in ranks) / 5))
    assert out[0].volatility is None and out[-1].rating_trend == pytest.approx(0.1)


def test_empty_shelf(spark):
    none = shelf(spark, [(0, 1, "A", 1)]).limit(0)
    for f in (S.share_of_shelf, S.concentration, S.brand_metrics, S.churn, S.product_history, S.market_metrics, P.movers, P.competitive_shifts, P.brand_performance):
        assert f(none).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, P.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, P.insert_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_graph(spark):
    e = spark.createDataFrame([("a", "p", "b", 1.0), ("b", "p", "c", 1.0), ("a", "q", "c", 0.5), ("c", "p", "d", 1.0)], "subject string, predicate string, object string, confidence double")
    assert {(r.entity, r.depth) for r in G.levels(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert tuple(G.shortest_paths(e, "a", "d").first()) == ("a>c>d", 2)
    assert G.shortest_paths(e, "d", "a").count() == 0
    assert G.pattern(e, [("?x", "p", "?y"), ("?y", "none", "?z")], ["x"]).count() == 0
    assert G.match(e, least=0.9).count() == 3


def test_every_rule_can_fire_and_not_fire(spark):
    assert len(N.RULES) == 37 and len({r[0] for r in N.RULES}) == 37
    types = {n: k for k, names in N._OPTIONAL.items() for n in names.split()}
    low = dict(zip(types, [None] * len(types), strict=True))
    base = dict.fromkeys(types, None) | {"is_target": True, "rank_shock": True, "has_badge": True, "has_campaign": True, "is_owned": True}
    tries = [
        dict(base, sos=0.3, hhi=0.1, competitors=9, avg_rank=5.0, current_rank=2, sos_change=0.1, cpi=160.0, rating_gap=0.1, volatility=1.0, streak=40, rank_change_7=-1, rank_change=-20, trend_keywords=3, rating_trend=0.2, reviews=200, discount_overlap=0.9, price_change=0.0, discount_score=0.9, revenue_yoy=1.0, growth_quarters=3, event_named=True, event_rank_change=-20, clusters={"Hydration": ["moisturizing", "hydrating"]}, tags=["Affordable"], rival_clusters={"Packaging": ["sturdy"], "Sensory": ["smooth"]}, summary="Customers love it"),
        dict(base, sos=0.1, hhi=0.3, competitors=4, sos_change=-0.1, cpi=120.0, rating_gap=-0.1, churn_rate=0.5, rank_change_7=2, volatility=9.0, growth_before=10.0, growth_now=2.0, clusters={"Usability": ["simple"], "Effectiveness": ["effective"]}, summary="Nice, but small"),
        dict(base, sos=0.25, hhi=0.3, cpi=80.0, rating_gap=0.2, tags=["good value"], rival_tags=["affordable"]), dict(base, sos=0.01, hhi=0.1), low,
    ]
    schema = "id int, " + ", ".join(f"{n} {k}" for n, k in types.items())
    frame = spark.createDataFrame([(i, *(t[n] for n in types)) for i, t in enumerate(tries)], schema)
    hits = N.infer(frame, ["id"]).collect()
    assert {h.rule for h in hits} == {r[0] for r in N.RULES}
    assert not [h for h in hits if h.id == 4]
    assert len([h for h in N.infer(frame, ["id"], 2).collect() if h.id == 0]) == 2


def test_merge_caps_each_step(spark):
    rows = spark.createDataFrame([("k", "Same text", 1, 0.8), ("k", "same TEXT", 2, 0.6), ("k", "other", 3, 0.4)], "k string, text string, ordinal int, confidence double")
    assert {r.insight: r.confidence for r in N.merge_insights(rows, ["k"]).collect()} == {"same text": 1.0, "other": 0.4}


def test_rrf_ignores_list_order_and_fusion_edges(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "item string, rank int")
    b = spark.createDataFrame([("y", 1)], "item string, rank int")
    one, two = ({r.item: r.score for r in R.rrf(x, ["item"]).collect()} for x in ([a, b], [b, a]))
    assert one == two and one["y"] == pytest.approx(1 / 62 + 1 / 61)
    s = spark.createDataFrame([(1, "v", 0.9), (1, "o", 0.0), (2, "v", 0.8), (2, "o", 1.5)], "q int, source string, score double")
    out = {r.q: r for r in R.fuse(s, "q", {"v": 0.4, "o": 0.6}).collect()}
    assert out[1].harmonic == 0 and out[1].geometric == 0 and out[1].conflict and out[2].weighted == pytest.approx(0.8) and out[2].level == "high"


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_ranking_metrics(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    assert one(spark, E.recall_at(arr(1, 2, 3), arr(2, 9), 2)) == 0.5
    assert one(spark, E.precision_at(arr(1, 2), arr(2), 10)) == 0.5
    assert one(spark, E.reciprocal_rank(arr(5, 7, 9), arr(9, 7))) == 0.5
    assert one(spark, E.ndcg_at(arr(1, 2), arr(2), 5)) == pytest.approx(1 / math.log2(3))
    assert one(spark, E.ndcg_at(arr(1, 2), arr(1, 2, 3), 5, "retrieved")) == pytest.approx(1.0)
    assert one(spark, E.ndcg_at(arr(1, 2), arr(1, 2, 3), 5)) < 1
    assert one(spark, E.recall_at(arr(1), arr(), 3)) == 1.0
    texts = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, E.set_f1(texts("A ", "b"), texts("a"))) == pytest.approx(2 / 3) == one(spark, E.set_f1(texts("a"), texts("A ", "b")))
    assert one(spark, E.set_f1(texts(), texts())) == 1.0 and one(spark, E.set_f1(texts(), texts("a"))) == 0.0


@pytest.mark.parametrize(
    "f,text,want",
    [(X.number, "$1,234.5", 1234.5), (X.number, "N/A", None), (X.price, "$12.50", 12.5), (X.price, "12.50", None), (X.price, "$9000", None), (X.rating, "4.5 out of 5 stars", 4.5), (X.rating, "9/5", None),
     (X.review_count, "1,234 ratings", 1234), (X.seconds_left, "2h 30m 5s", 9005), (X.seconds_left, "soon", None), (X.view_count, "1.2k", 1200), (X.view_count, "3M", 3_000_000), (X.domain, "https://www.a.com/x", "a.com"), (X.safe_int, "x", 0), (X.safe_int, "7.9", 7)],
)
def test_scalars(spark, f, text, want):
    assert one(spark, f(F.lit(text))) == want
    one(spark, f(F.lit(None).cast("string")))


def test_tokens_split_accents_and_keep_hangul(spark):
    assert one(spark, R.tokens(F.lit("Éoire A ab12 가나 x"))) == ["oire", "ab", "12", "가나"]


def test_overlaps_equal_plain_condition(spark):
    rows = [(i, i % 3, DAY + dt.timedelta(7 * i % 50), DAY + dt.timedelta(7 * i % 50 + i % 11)) for i in range(40)]
    d = spark.createDataFrame(rows, "id int, k int, a date, b date")
    got = {r.id for r in P.overlaps(d.where("id < 20"), d.where("id >= 20"), "k", "a", "b", 5).collect()}
    assert got == {x[0] for x in rows[:20] if any(x[1] == y[1] and y[2] <= x[3] and y[3] >= x[2] for y in rows[20:])}


def test_stream_equals_batch(spark, tmp_path):
    events = V.table(spark, SF, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = M.windows(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = sorted(map(tuple, spark.table("win").select("start", "event_type", "events").collect()))
    assert got == sorted(map(tuple, M.windows(events).select("start", "event_type", "events").collect()))


def test_alerts_are_delivered_once(spark, tmp_path):
    events = V.table(spark, SF, "events")
    events.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        M.deliver(M.threshold_alerts(stream, {"error": 50.0}), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == M.threshold_alerts(events, {"error": 50.0}).count()


def test_breaker_opens_and_closes(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at + dt.timedelta(seconds=s), k) for s, k in ((0, "error"), (1, "error"), (2, "error"), (10, "view"), (90, "view"))]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    M.breaker(stream).writeStream.format("memory").queryName("brk").outputMode("append").trigger(availableNow=True).start().awaitTermination(60)
    assert [r.state for r in spark.table("brk").orderBy("ts").collect()] == ["open", "closed"]


def test_claims_have_offsets_and_context(spark):
    text = "up 12% then 7.5 % of all"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "none")], "doc_id long, text string")
    out = sorted(map(tuple, C.extract(docs, ["percent"]).collect()))
    assert out == [(1, "percent", 0, 3, "12%", "up ", " then "), (1, "percent", 1, 12, "7.5 %", " then ", " of all")]
    assert all(text[r[3] :].startswith(r[4]) for r in out)


def test_claims_are_verified(spark):
    claims = spark.createDataFrame([("a", 104.0), ("b", 109.0), ("c", 150.0), ("d", 1.0)], "k string, claimed double")
    facts = spark.createDataFrame([(k, 100.0) for k in "abc"], "k string, fact double")
    assert {r.k: r.status for r in C.verify(claims, facts, ["k"]).collect()} == {"a": "verified", "b": "close", "c": "refuted", "d": "unknown"}


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 9), ("g", 3, 4), ("h", 1, 99)], "k string, i int, n int")
    assert sorted((r.k, r.i) for r in C.within_budget(rows, "k", [F.col("i")], F.col("n"), 10).collect()) == [("g", 1), ("g", 3)]


def test_fallback_uses_later_sources_for_new_keys_only(spark):
    a, b = spark.createDataFrame([(1, "a")], "d int, v string"), spark.createDataFrame([(1, "b"), (2, "b"), (2, "c")], "d int, v string")
    assert sorted(map(tuple, C.with_fallback([a, b], "d").collect())) == [(1, "a"), (2, "b"), (2, "c")]


def test_registry(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100
    assert registry.flagship(spark, SF).count() > 0


def test_scan_reads_only_needed_columns(spark):
    plan = registry.queries()["deals_by_brand"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "PushedFilters" in plan


def test_periods_take_every_line(spark, tmp_path):
    at = lambda day: dt.datetime(1997, 1, day)
    spark.createDataFrame([(1, 7, at(1)), (2, 7, at(2)), (3, 8, at(1))], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(1, 2, "N", at(9)), (2, 3, "R", at(5)), (2, 1, "A", at(3)), (3, 1, "N", at(4))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert list(map(tuple, registry.queries()["period_overlap"](spark, str(tmp_path)).collect())) == [(1, 7)]


def test_rank_pivot_has_every_month(spark):
    out = registry.queries()["rank_series_pivot"](spark, SF)
    months = {r.snapshot_date.strftime("r%Y%m") for r in V.shelf(spark, SF).select("snapshot_date").distinct().collect()}
    assert set(out.columns) == months | {"asin"} and len(months) > 3
    held = V.shelf(spark, SF).select("asin", "snapshot_date").distinct().count()
    assert sum(v is not None for r in out.drop("asin").collect() for v in r) == held


def test_gold_is_every_vector_of_the_label(spark, tmp_path):
    rows = [(i, [1.0, i / 1000], 0) for i in range(1, 40)] + [(100, [1.0, 0.0395], 0), (101, [0.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert list(map(tuple, run("recall_precision_mrr"))) == [(100, 0.25, 1.0, 1.0, 1.0)]
    assert list(map(tuple, run("ndcg"))) == [(100, 1.0, 1.0)]
    assert list(map(tuple, run("set_f1"))) == [(100, 0.4, 0.25)]


def test_ranked_measures_equal_the_lists(spark):
    cases = {1: ([5, 7, 9, 4], [9, 4, 30, 31]), 2: ([1, 2], [3]), 3: ([8], [8])}
    rows = [(q, i + 1, x in g, len(g)) for q, (f, g) in cases.items() for i, x in enumerate(f)]
    got = {r.q: r for r in E.ranked(spark.createDataFrame(rows, "q int, rank int, right boolean, gold long"), "q").collect()}
    for q, lists in cases.items():
        f, g = (F.array(*map(F.lit, x)) for x in lists)
        want = [E.recall_at(f, g, 10), E.precision_at(f, g, 10), E.reciprocal_rank(f, g), E.hits_at(f, g, 3), E.ndcg_at(f, g, 10), E.ndcg_at(f, g, 10, "retrieved"), E.set_f1(f.cast("array<string>"), g.cast("array<string>")), E.jaccard(f, g)]
        assert list(got[q])[1:] == pytest.approx(list(spark.range(1).select(*want).first()))


def test_rules_see_product_history_and_churn(spark):
    history = S.product_history(V.shelf(spark, SF)).collect()
    churn = {(r.snapshot_date, r.category_id): r.churn_rate for r in S.churn(V.shelf(spark, SF)).collect()}
    best, shocked = {}, set()
    for r in history:
        key = (r.snapshot_date, r.category_id, r.brand)
        best[key] = min(best.get(key, r), r, key=lambda x: x.rank)
        if r.rank_shock:
            shocked.add(key)
    want = {"prime_day_impact": sum(k[0].month == 7 and (r.rank_change or 0) < -10 for k, r in best.items()), "market_disruption": sum(churn[k[:2]] > 0.2 for k in shocked),
            "rank_decline_alert": sum((r.rank_change_7 or 0) > 0 and (r.volatility or 0) > 5 for r in best.values()), "viral_effect": sum(r.price_change is not None and abs(r.price_change) < 0.05 and r.rank_change_7 < 0 for r in best.values())}
    got = {r.rule: r.entities for r in registry.queries()["rule_hits"](spark, SF).collect()}
    assert {n: got.get(n, 0) for n in want} == want and want["prime_day_impact"]


def test_promotion_history(spark):
    steps = [(9, 0.0), (5, 6.0), (3, 4.0), (8, 9.0), (2, 10.0)]
    rows = shelf(spark, [(i, 1, "A", r) for i, (r, _) in enumerate(steps)]).drop("discount_percent").join(spark.createDataFrame([(DAY + dt.timedelta(i), d) for i, (_, d) in enumerate(steps)], "snapshot_date date, discount_percent double"), "snapshot_date")
    out = sorted(S.product_history(rows, 2).collect(), key=lambda r: r.snapshot_date)
    assert [r.discount_overlap for r in out] == [None, 1.0, 0.5, 0.5, pytest.approx(2 / 3)]
    assert [r.discount_score for r in out] == [None, 1.0, 0.5, pytest.approx(1 / 3), 0.5] and [r.price_change for r in out] == [None, None, 0.0, 0.0, 0.0]


def test_eviction_takes_the_lowest_tenth(spark):
    edges = spark.createDataFrame([(f"s{i}", "p", "o", 0.1 if i < 3 else 0.9) for i in range(59)], "subject string, predicate string, object string, confidence double")
    assert [(r.n, r.evicted) for r in G.eviction(edges).orderBy("score").collect()] == [(3, 3), (56, 2)]


def test_vector_blocks_give_the_same(spark):
    v = V.table(spark, SF, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    assert sorted(R.vector_topk(asked, v, 5, block=7).collect()) == sorted(R.vector_topk(asked, v, 5).collect())


def test_scans_of_a_traversal_grow_with_its_depth(spark):
    edges = V.triples(spark, SF)
    scans = [G.levels(edges, "EUROPE", d)._jdf.queryExecution().executedPlan().toString().count("FileScan") for d in (1, 2, 3)]
    assert scans[2] - scans[1] == scans[1] - scans[0]


def test_pattern_refuses_a_cross_product(spark):
    edges = V.triples(spark, SF)
    with pytest.raises(ValueError):
        G.pattern(edges, [("?a", "hasProduct", "?b"), ("?c", "parentCategory", "?d")], ["a", "c"])
