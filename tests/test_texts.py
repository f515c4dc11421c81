"""Chunkers against plain Python, and edge cases of text and evaluation operators."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfloom.functions import scalars as X
from shelfloom.operators import dashboard as D
from shelfloom.operators import evaluation as E
from shelfloom.operators import graph as G
from shelfloom.operators import retrieval as R
from shelfloom.operators import texts as T


def one(spark, text, **columns):
    frame = spark.createDataFrame([(text,)], "text string")
    return frame.select(*(c.alias(n) for n, c in columns.items())).first()


def plain_packed(text, size):
    out, current = [], ""
    for piece in filter(None, (p.strip() for p in text.split("\n\n"))):
        if len(current) + len(piece) + 2 <= size:
            current = f"{current}\n\n{piece}" if current else piece
            continue
        out += [current] if current else []
        current = piece if len(piece) <= size else ""
        out += [] if current else [piece[a : a + size] for a in range(0, len(piece), size)]
    return out + ([current] if current else [])


def plain_overlapping(units, size):
    chunks, part = [], []
    for unit in units:
        if part and sum(len(u) + 1 for u in part) + len(unit) > size:
            chunks.append(part)
            part = part[-1:]
        part = [*part, unit]
    return [" ".join(c) for c in chunks + ([part] if part else [])]


def test_packing_equals_plain_python(spark):
    dice = random.Random(1)
    texts = ["\n\n".join("".join(dice.choices("ab ", k=dice.randrange(0, 60))) for _ in range(dice.randrange(0, 12))) for _ in range(60)] + ["", "x" * 95]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {r.i: r.p for r in frame.select("i", T.packed(F.col("text"), 40).alias("p")).collect()}
    assert got == {i: plain_packed(t, 40) for i, t in enumerate(texts)}


def test_overlap_equals_plain_python(spark):
    dice = random.Random(2)
    texts = [[("s%d " % i) * dice.randrange(1, 9) for i in range(dice.randrange(0, 15))] for _ in range(40)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, units array<string>")
    got = {r.i: r.p for r in frame.select("i", T.overlapping(F.col("units"), 50).alias("p")).collect()}
    assert got == {i: plain_overlapping(t, 50) for i, t in enumerate(texts)}


def test_sentences(spark):
    text = "One thing. Costs 3.5 now! Really?\nBy J. Smith it is 3. Next"
    assert one(spark, text, s=T.sentences(F.col("text"))).s == ["One thing.", "Costs 3.5 now!", "Really?", "By J. Smith it is 3. Next"]


def test_sections_keep_tables_whole(spark):
    text = "# Title\nintro\n**Prices**\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n## Second\n" + "word " * 200
    rows = T.sections(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), size=300).collect()
    tables = [r for r in rows if r.kind == "table"]
    assert [(r.title, r.content) for r in tables] == [("Prices", "| a | b |\n|---|---|\n| 1 | 2 |")]
    assert {r.id for r in rows} == {1} and {r.title for r in rows if r.kind == "text"} == {"Title", "Second"}
    assert max(len(r.content) for r in rows if r.kind == "text") <= 300
    assert re.sub(r"\s", "", "".join(r.content for r in sorted(rows, key=lambda r: (r.section, r.part)) if r.section == 1)) == "Second" + "word" * 200


def test_query_type_edges(spark):
    groups = {"a": {"keywords": ["x"]}, "b": {"keywords": ["y"], "patterns": ["z"]}}
    pick = lambda t: tuple(one(spark, t, q=T.query_type(F.col("text"), groups)).q)
    assert pick("x y") == ("a", 0.5, 2.0) and pick("y z") == ("b", 1.0, 3.0) and pick("z") == ("unknown", 0.0, 1.0) and pick("") == ("unknown", 0.0, 0.0)


def test_evaluation_edges(spark):
    frame = spark.createDataFrame([([], []), (["A ", "b"], []), ([], ["a"]), (["a", "b"], ["a", "c"])], "f array<string>, g array<string>")
    got = frame.select(E.set_precision(F.col("f"), F.col("g")).alias("p"), E.set_recall(F.col("f"), F.col("g")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (0.5, 0.5)]
    items = spark.createDataFrame([(0.1, None, True), (0.9, 0.2, False)], "entity_link_f1 double, groundedness double, kg boolean")
    assert [r.t for r in items.select(E.fail_tags(items, F.col("kg")).alias("t")).collect()] == [["L1_mapping_fail"], ["L5_grounding_fail"]]


def test_brand_names(spark):
    rows = [(" Rare ", "x"), ("Unknown", "Tree Hut scrub"), (None, "Tree Hut"), ("other", "new TREE HUT scrub"), ("other", None), ("", "Tree Hut")]
    got = [r.b for r in spark.createDataFrame(rows, "b string, t string").select(X.normal_brand(F.col("b"), F.col("t")).alias("b")).collect()]
    assert got == ["Rare Beauty", "Unknown", None, "Tree Hut", "other", ""]


def test_normalised_equal_values(spark):
    frame = spark.createDataFrame([(1, 2.0), (1, 2.0)], "k long, v double")
    assert {r.v for r in R.normalised(frame, "k", "v", "z").collect()} == {0.5}
    assert {r.v for r in R.normalised(frame, "k", "v", "min_max").collect()} == {1.0}
    assert {r.v for r in R.normalised(frame, "k", "v", "softmax").collect()} == {0.5}


@pytest.mark.parametrize("price,rank,want", [(13.0, 5, 90), (13.0, 20, 70), (13.0, 60, 40), (12.0, 1, 50), (None, 1, 0), (0.0, 1, 0)])
def test_premium_defense(spark, price, rank, want):
    frame = spark.createDataFrame([(price, 10.0, rank)], "p double, m double, r int")
    assert frame.select(D.premium_defense(F.col("p"), F.col("m"), F.col("r")).alias("x")).first().x == want


def test_metadata_filter_empty_and_null(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert frame.where(D.metadata_filter({})).count() == 2 and frame.where(D.metadata_filter({"k": "a"})).count() == 1 and frame.where(D.metadata_filter({"$or": [{"k": {"$in": ["z"]}}, {"v": 2}]})).count() == 1


def test_inconsistencies(spark):
    edges = spark.createDataFrame(
        [("B", "hasProduct", "p1", 1.0), ("B", "hasProduct", "p2", 1.0), ("p1", "belongsToCategory", "c", 1.0), ("p1", "belongsToCategory", "d", 1.0), ("p2", "hasProduct", "p3", 1.0), ("C", "directCompetitor", "B", 1.0)],
        "subject string, predicate string, object string, confidence double",
    )
    got = {(r.entity, r.problem) for r in G.inconsistencies(edges).collect()}
    assert got == {("p1", "several categories"), ("p2", "no category"), ("p2", "brand and product"), ("p3", "no category"), ("C", "brand without products")}


def test_lists_of_folds_keep_order_over_many_pieces(spark):
    from shelfloom.operators import folds

    rows = spark.range(0, 400, 37).select(F.sequence(F.lit(0), F.col("id")).alias("all"))
    kept = lambda acc, x: F.when(x % 3 == 0, acc).otherwise(folds.added(acc, F.array(x, -x)))
    got = rows.select("all", F.aggregate("all", folds.empty("bigint"), kept, folds.whole).alias("kept")).collect()
    assert all(r.kept == [y for x in r["all"] if x % 3 for y in (x, -x)] for r in got) and any(len(r.kept) > 3 * folds.STEP for r in got)
    long = "\n\n".join("p%d" % i for i in range(3000))
    parts = one(spark, long, p=T.packed(F.col("text"), 20)).p
    assert parts == plain_packed(long, 20) and len(parts) > 500


def plain_figures(text):
    low, out = text.lower(), []
    for p in E.KPI_PATTERNS:
        out += [float(m[1]) for m in re.finditer(p, low)]
    return out or [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?", text)]


def test_figures_met(spark):
    dice = random.Random(6)
    words = ["SoS: 23.5%", "점유율 24 %", "HHI 1250", "시장집중도:1200", "CPI: 98.6", "churn 3", "growth: -2.5%", "rank #4", "순위 4", "is 0", "-7", "12.25", "share  of shelf 0.0005", "price index: 100"]
    pairs = [tuple(" and ".join(dice.sample(words, dice.randrange(0, 4))) for _ in "ab") for _ in range(120)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.met for r in rows.select("i", E.figures_met(F.col("a"), F.col("b")).alias("met")).collect()}
    for i, (a, b) in enumerate(pairs):
        said, wanted = plain_figures(a), plain_figures(b)
        near = lambda x, y: x == y or (abs(x - y) < 0.001 if abs(y) < 0.001 else abs(x - y) / abs(y) <= 0.05)
        assert got[i] == pytest.approx(sum(any(near(x, y) for x in said) for y in wanted) / len(wanted) if wanted else 1.0)
    assert [r[0] for r in spark.createDataFrame([(None, "HHI 3"), ("HHI 3", None)], "a string, b string").select(E.figures_met(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_category_met(spark):
    rows = [("A Lip Care product", "lip_care", 1), ("lip care, not Lip Makeup", "lip care", 0), ("Lip Makeup", "lip_care", 0), ("lip careful", "lip_care", 0), ("립케어 제품", " 립 케어 ", 1), ("립케어제품", "lip_care", 0), ("beauty and face powder", "BEAUTY", 1), ("skin care", "toys", 0), (None, "beauty", 0), ("beauty", None, 0)]
    frame = spark.createDataFrame([(i, a, g) for i, (a, g, _) in enumerate(rows)], "i int, a string, g string")
    got = {r.i: r.met for r in frame.select("i", E.category_met(F.col("a"), F.col("g")).alias("met")).collect()}
    assert [got[i] for i in range(len(rows))] == [float(x) for _, _, x in rows]


def test_value_problems(spark):
    rows = [("ok", ["strong", "other"], "0.5", "3"), ("two", ["strong", "niche"], None, None), ("text", None, "much", "1.5"), ("big", [], "1.2", "0"), ("low", ["niche"], "-0.1", "x"), ("nan", ["niche"], "NaN", "4.0"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "entity string, classes array<string>, share string, rank string")
    got = {(r.entity, r.problem, r.severity) for r in G.value_problems(frame).collect()}
    assert got == {("two", "several classes", "error"), ("text", "share is no number", "error"), ("text", "no rank", "warning"), ("big", "share out of range", "warning"), ("big", "no rank", "warning"), ("low", "share out of range", "warning"), ("low", "no rank", "warning"), ("nan", "share is no number", "error")}


def test_alert_edges(spark):
    alerts = spark.createDataFrame([("d2", "a", "drop", "critical"), ("d1", "a", "drop", "warning"), ("d1", "a", "drop", "warning"), ("d1", "b", None, "info"), ("d1", None, "drop", "info")], "day string, asin string, alert string, severity string")
    got = {(r.subject, r.predicate, r.object, r.properties.day, r.properties.severity) for r in G.alert_edges(alerts, ["day"]).collect()}
    assert got == {("a", "hasAlert", "drop", "d1", "warning"), ("b", "hasAlert", "unknown", "d1", "info")}


def test_freshness(spark):
    from shelfloom.operators import claims as C

    rows = [("today", "2024-01-09 12:00:00", "verified", 0.5), ("today", "2024-01-09 00:00:00", "verified", 0.0), ("today", "2024-01-08 23:59:59", "unverified", 0.3), ("other", "2024-01-03 00:00:00", "verified", 0.0), (None, "2024-01-10 00:00:00", "verified", 1.0), ("recent", None, "unknown", 0.0)]
    frame = spark.createDataFrame([(i, c, last) for i, (c, last, _, _) in enumerate(rows)], "i int, c string, last string")
    got = {r.i: (r.x.status, r.x.confidence) for r in frame.select("i", C.freshness(F.col("c"), F.col("last").cast("timestamp"), F.lit("2024-01-10 00:00:00")).alias("x")).collect()}
    assert got == {i: (status, confidence) for i, (_, _, status, confidence) in enumerate(rows)}


def test_nested_reports(spark):
    rows = [(1, 2024, [("Asia", 5), ("EU", 6), ("ASIA", 7)], ["Prime day", "amazon fair"]), (2, 2023, [("asia", 8)], ["none"]), (3, 2024, None, None), (4, 2024, [], [])]
    frame = spark.createDataFrame(rows, "id int, year int, regions array<struct<region: string, v: int>>, events array<string>")
    assert sorted((r.id, r.v) for r in D.of_reports(frame, "regions", "region", "aSia", ["id"]).collect()) == [(1, 5), (1, 7), (2, 8)]
    assert sorted(r.v for r in D.of_reports(frame, "regions", "region", "asia", ["id"], year=2024).collect()) == [5, 7]
    assert sorted(r.event for r in D.report_events(frame, "events", ["AMAZON", "prime"], ["id"]).collect()) == ["Prime day", "amazon fair"]
