"""Sentiment, ownership, copies, similar names and semantic chunks against plain Python, and edge cases."""

import random
from datetime import date
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfloom.operators import claims as C
from shelfloom.operators import dashboard as D
from shelfloom.operators import evaluation as E
from shelfloom.operators import fuzzy
from shelfloom.operators import graph as G
from shelfloom.operators import retrieval as R
from shelfloom.operators import rules as N
from shelfloom.operators import sentiment as M
from shelfloom.operators import texts as T
from shelfloom.sources import backups as B


def plain_closest(text, names, least):
    scored = [(SequenceMatcher(None, text.lower().strip(), n.lower().strip()).ratio(), n) for n in names]
    top = max(s for s, _ in scored)
    return (next(n for s, n in scored if s == top), top) if top >= least else (None, 0.0)


def test_closest_equals_plain_python(spark):
    dice = random.Random(3)
    names = ["Alpha Beta", "alpha bet", "Gamma", "Gamut", "delta"]
    texts = ["".join(dice.choice("abeglmtpu ") for _ in range(dice.randrange(1, 12))) for _ in range(200)] + [n[:-1] for n in names] + [" GAMMA ", "alpha beta"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "i int, t string")
    got = {r.i: (r.h.name, r.h.score) for r in frame.select("i", fuzzy.closest(names, 0.6)(F.col("t")).alias("h")).collect()}
    assert got.pop(-1) == got.pop(-2) == (None, 0.0)
    assert got == {i: plain_closest(t, names, 0.6) for i, t in enumerate(texts)} and sum(n is not None for n, _ in got.values()) > 5
    assert frame.where("false").select(fuzzy.closest(names)(F.col("t"))).count() == 0


def test_fuzzy_set_f1(spark):
    cases = [(["Gamma ", "x"], ["gamma"], 2 / 3), (["gamm"], ["gamma", "zzz"], 2 / 3), ([], [], 1.0), (["a"], None, 0.0), (None, [], 1.0), (["cos", "cos"], ["other"], 0.0), (["short"], ["long name"], 1.0)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = {r.i: r.f for r in frame.select("i", fuzzy.set_f1(0.8, {"short": "long name"})(F.col("a"), F.col("b")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == pytest.approx([c[2] for c in cases])


def plain_chunks(vectors, sizes, share, least, low, high):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0
    sims = [float(unit(a) @ unit(b)) for a, b in zip(vectors, vectors[1:])]
    limit = max(np.percentile(sims, share * 100), least) if sims else least
    out, used, chunk = [], 0, 0
    for size, sim in zip(sizes, [*sims, 9.0]):
        out.append(chunk)
        used += size
        if (sim < limit and used >= low) or used >= high:
            chunk, used = chunk + 1, 0
    return out


def test_semantic_chunks_equal_plain_python(spark):
    make = np.random.default_rng(4)
    docs = {d: (make.normal(size=(n, 6)).cumsum(axis=0), [int(x) for x in make.integers(5, 90, n)]) for d, n in enumerate((1, 2, 9, 40, 25))}
    docs[9] = (np.zeros((4, 6)), [60, 60, 60, 60])
    rows = [(d, i, s, [float(x) for x in v]) for d, (vs, ss) in docs.items() for i, (v, s) in enumerate(zip(vs, ss))]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc int, place int, size int, vector array<double>")
    got = {}
    for r in T.semantic_chunks(frame, 0.25, 0.5, 100, 200).orderBy("doc", "place").collect():
        got.setdefault(r.doc, []).append(r.chunk)
    assert got == {d: plain_chunks(v, s, 0.25, 0.5, 100, 200) for d, (v, s) in docs.items()} and max(got[3]) > 3
    assert T.semantic_chunks(frame.where("false")).count() == 0


def test_sentiments_of_few_products(spark):
    rows = [("p1", ["Hydrating serum", "sturdy", "odd"], "They LOVE it", True), ("p2", ["sturdy", "sturdy"], None, True), ("p3", ["gentle"], "x", False), ("p4", [], "", True)]
    edges = M.sentiment_edges(spark.createDataFrame(rows, "product string, tags array<string>, summary string, success boolean"))
    assert edges.count() == 5
    one = {r["product"]: r for r in M.product_sentiments(edges).collect()}
    assert one["p1"].tags == ["Hydrating serum", "odd", "sturdy"] and one["p1"].clusters == {"Hydration": ["Hydrating serum"], "Packaging": ["sturdy"]} and one["p1"].summary == "They LOVE it"
    made = spark.createDataFrame([("A", "p1"), ("A", "p2"), ("B", "p3")], "brand string, product string")
    profile = {(r.brand, r.cluster): (r.products, r.dominant, r.mentions) for r in M.brand_profile(edges, made).collect()}
    assert profile == {("A", "Packaging"): (2, "sturdy", 2), ("A", "Hydration"): (2, "sturdy", 1), ("A", None): (2, "sturdy", 1), ("B", None): (1, None, None)}
    pair = M.compared(edges, spark.createDataFrame([("p1", "p2"), ("p1", "p3")], "one string, two string")).collect()
    assert {(r.two, tuple(r.common), tuple(r.only_one), tuple(r.only_two)) for r in pair} == {("p2", ("sturdy",), ("Hydrating serum", "odd"), ()), ("p3", (), ("Hydrating serum", "odd", "sturdy"), ())}
    assert {r["product"] for r in M.tagged(edges, "sturdy").collect()} == {"p1", "p2"} and M.tagged(edges, "sturdy", made, "b").count() == 0
    rivals = spark.createDataFrame([("A", "B"), ("B", "A")], "brand string, rival string")
    hits = N.infer(M.brand_sentiment_context(edges, made, rivals), ["brand"]).collect()
    assert [h for h in hits if h.brand == "A" and h.rule == "packaging_weakness"] == []


def test_ownership(spark):
    rows = [("a", "g", "S", "kr", 2024), ("b", "g", None, "kr", None), ("c", None, "S", None, None), ("", "g", "S", "kr", 1)]
    edges = G.ownership_edges(spark.createDataFrame(rows, "brand string, owner string, segment string, country string, acquired int"))
    got = {r.brand: tuple(r)[1:] for r in G.ownership(edges).collect()}
    assert got == {"a": ("g", "S", "kr", "2024", 1), "b": ("g", "Unknown", "kr", None, 1), "c": (None, "S", None, None, 0)}
    assert [r.sister for r in G.sisters(edges, "a").collect()] == ["b"] and G.sisters(edges, "c").count() == 0


def test_copies_are_restored_by_day(spark, tmp_path):
    folder, rows = f"file://{tmp_path}/copies", lambda n: spark.range(n)
    for day, n in ((date(2024, 1, 1), 1), (date(2024, 3, 1), 2), (date(2024, 3, 1), 3), (date(2024, 3, 9), 4)):
        B.save(rows(n), folder, day)
    assert [B.restore(spark, folder, d).count() for d in (date(2024, 3, 5), date(2024, 3, 9), date(2024, 1, 20), date(2025, 1, 1))] == [3, 4, 1, 0]
    assert B.kept(spark, folder, date(2024, 3, 9)).count() == 7


def test_layers_and_masks(spark):
    x = {n: F.lit(1.0) for n in "entity_link_f1 concept_map_f1 constraint_f1 recall precision mrr hits edge_f1 type_consistency".split()} | {"violation_rate": F.lit(0.0)}
    scores = spark.range(1).select(E.overall(x, F.lit(True), [F.lit(1.0), F.lit(None)]).alias("a"), E.overall(x, F.lit(False), [F.lit(None).cast("double")]).alias("b")).first()
    assert tuple(scores) == pytest.approx((1.0, 0.55))
    ranked = spark.createDataFrame([(1, 1, 0.0), (1, None, 2.0), (1, 2, 1.0), (2, 1, 0.0)], "q int, rank int, gain double")
    assert {r.q: r.ndcg for r in E.graded_ndcg(ranked, "q").collect()} == {1: pytest.approx((1 / np.log2(3)) / (2 + 1 / np.log2(3))), 2: 0.0}
    queue = N.action_queue(spark.createDataFrame([(1, 0, None, None, None), (2, 1, 120.0, -0.1, 0.5)], "k int, shocks int, cpi double, rating_gap double, churn_rate double"), ["k"])
    assert [(r.k, r.action) for r in queue.where("place < 2").orderBy("k", "place").collect()] == [(1, "all_quiet"), (2, "check_moved_products"), (2, "check_price_against_rating")]
    line = spark.createDataFrame([("token = 'abcdefghijklmnop1' sk-short tvly-" + "a" * 20, None)], "a string, b string")
    assert tuple(line.select(R.masked(F.col("a"), R.KEYS), R.masked(F.col("b"), R.KEYS)).first()) == ("token=**** sk-short tvly-****", None)


def test_report_issues_and_scores(spark):
    cases = {
        None: [], "": [], "순위: 5 → 40": ["rank_jump"], "12위에서 3위로": [], "SoS: 50% SoS 50.5%": ["share_above_limit"], "HHI: 10000, HHI 10001": ["concentration_above_limit"],
        "Tree Hut, Burt's Bees, wet n wild": [], "burt's 1위, unknown": ["shortened_brand", "unknown_brand"],
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: r.x for r in frame.select("i", C.report_issues(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    claims = spark.createDataFrame([(1, "numerical", "verified", 1.0), (1, "comparative", "refuted", 0.0), (2, None, None, 1.0), (3, "logical", "verified", 1.0)], "k int, kind string, status string, confidence double")
    assert {r.k: (r.score, r.grade) for r in C.text_scores(claims, "k").collect()} == {1: (0.652, "medium"), 2: (0.65, "medium"), 3: (1.0, "high")}
    # 0.5995 is half way: it goes up, however a double holds it and in whatever order claims come
    half = spark.createDataFrame([(1, "temporal", "close", 0.365), (2, "logical", "close", 0.8)] + [(2, "logical", "refuted", 0.0)] * 5 + [(2, "comparative", "refuted", 0.0)], "k int, kind string, status string, confidence double")
    assert {r.k: (r.score, r.grade) for r in C.text_scores(half, "k").collect()} == {1: (0.6, "medium"), 2: (0.11, "low")}
    ranks = spark.createDataFrame([(3, 3), (3, 4), (3, 5), (3, None)], "a int, b int").select(C.rank_status(F.col("a"), F.col("b")).alias("x")).collect()
    assert [(r.x.status, r.x.confidence) for r in ranks] == [("verified", 1.0), ("close", 0.8), ("refuted", 0.0), ("unknown", 0.0)]
    named = spark.range(1).select(C.context_names(F.expr("array(struct('b' AS subject, 'p' AS predicate, '' AS object), struct(string(null) AS subject, 'p' AS predicate, 'a' AS object))"), 1).alias("x")).first().x
    assert (named.entities, named.relations) == (["a"], ["p"])


def test_ladder_and_growth(spark):
    day = date(2024, 1, 2)
    rows = [("a", "x", 9, -3, 4.5, 0), ("b", "x", 9, 3, 4.5, 0), ("c", "x", 9, 2, 3.9, 99), ("d", "x", 9, None, 0.0, 16), ("e", "x", 5, 0, None, 15), ("f", "x", 6, 0, 4.0, 15), ("f", "w", 6, 9, 4.0, 15), ("e", "y", 7, 9, 4.0, 15)]
    history = spark.createDataFrame([(day, *r) for r in rows] + [(date(2023, 1, 1), "z", "x", 1, 0, 1.0, 0)], "snapshot_date date, asin string, category_id string, rank int, rank_change int, rating double, rank_range int")
    got = {r.asin: (r.signal, r.action, r.priority) for r in D.ladder(history).collect()}
    assert got == {"a": ("rise", "MONITOR", "P1"), "b": ("fall", "CHECK", "P1"), "c": ("low_rating", "CHECK", "P1"), "d": ("volatile", "DEEP DIVE", "P1"), "e": ("top", "MONITOR", "P2"), "f": ("fall", "CHECK", "P1")}
    promos = spark.createDataFrame([(15.0, None, None), (15.1, None, None), (None, "5%", None), (0.0, "", "Lightning Deal")], "d double, c string, b string")
    assert [r.g for r in promos.select(D.growth_type(F.col("d"), F.col("c"), F.col("b")).alias("g")).collect()] == ["organic", "discount_based", "discount_based", "discount_based"]
