"""Stored indexes, tables and versions, linking, fallbacks and model slots."""

import glob
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfloom.functions import scalars as X
from shelfloom.operators import linking, slots, text_index
from shelfloom.operators import retrieval as R
from shelfloom.operators import texts as T
from shelfloom.operators.text_index import TextIndex
from shelfloom.operators.vector_index import VectorIndex
from shelfloom.plans import search, stored as plans
from shelfloom.sources import stored

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_text_index(spark, tmp_path):
    docs = table(spark, "documents").select("doc_id", "text")
    asked = table(spark, "benchmark").select(F.col("item_id").alias("query"), "text")
    whole = TextIndex(spark, str(tmp_path / "whole")).append(docs, first=True)
    parts = TextIndex(spark, str(tmp_path / "parts")).append(docs.where("doc_id % 3 > 0"), first=True)
    parts.append(docs.where("doc_id % 2 = 0"))  # a third of these is there already
    parts.append(docs)
    rows = lambda i, **o: {(r.query, r.doc, round(r.score, 9), r["rank"]) for r in i.search(asked, **o).collect()}
    found = rows(whole)
    assert found and rows(parts) == found and rows(whole, prune=True) == found and rows(parts, prune=True) == found
    few = spark.createDataFrame([(1, "zzz"), (2, ""), (3, None)], "query int, text string")
    assert rows(TextIndex(spark, str(tmp_path / "whole"))) == found and whole.search(few).collect() == []


def test_text_index_reads_the_asked_buckets_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} common text") for i in range(60)], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i")).append(docs, first=True)
    asked = index.asked(spark.createDataFrame([(1, "common")], "query int, text string"))
    chosen = index._chosen(asked)
    plan = index._of(chosen, "postings")._jdf.queryExecution().executedPlan().toString()
    assert len(chosen) == 1 and re.search(rf"PartitionFilters: \[[^\]]*= {chosen[0]}\)", plan)
    assert len(glob.glob(f"{tmp_path}/i/postings/bucket=*")) > 3


def test_rare_terms_leave_blocks_out(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common " * 5 + ("rare " * 40 if i == 7 else "other words")) for i in range(400)], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path / "i")).append(docs, first=True)
    asked = index.asked(spark.createDataFrame([(1, "rare common")], "query int, text string"))
    assert index.promising(asked, 1).count() < asked.count() * 10 and index.search(spark.createDataFrame([(1, "rare common")], "query int, text string"), 1, prune=True).first().doc == 7


def test_vector_index(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    asked = v.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    index = VectorIndex.fit(v.where("vec_id < 300"), str(tmp_path / "v"))
    fitted = index.middle.copy()
    index.append(v.where("vec_id >= 300"))
    assert (index.middle == fitted).all() and index.rows().count() == v.count()
    rows = lambda df: {(r.query, r.vec_id) for r in df.collect()}
    true = rows(R.vector_topk(asked, v))
    assert rows(index.search(asked)) == true
    probes = round(search.PROBED * len(index.middle))
    assert len(rows(index.search(asked, probes=probes)) & true) >= 0.9 * len(true)
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 64), (3, [1.0])], "vec_id long, embedding array<double>")
    index.append(odd)
    assert index.rows().count() == v.count()


def test_fallback(spark):
    rows = [(1, i, float(i), i % 2 == 0) for i in range(20)] + [(2, i, float(i), i == 0) for i in range(20)] + [(3, 1, 1.0, False)]
    out = R.with_fallback(spark.createDataFrame(rows, "query int, doc int, score double, passes boolean"), k=5).collect()
    of = lambda q: [(r.doc, r.filtered) for r in sorted(out, key=lambda r: r["rank"]) if r.query == q]
    assert of(1) == [(d, True) for d in (18, 16, 14, 12, 10)] and of(2) == [(d, False) for d in (19, 18, 17, 16, 15)] and of(3) == [(1, False)]


def test_both_outcomes_of_the_fallback_occur(spark):
    assert {r.filtered for r in search.QUERIES["hybrid_fallbacks"](spark, "/root/testdata/sf0.01").collect()} == {True, False}


def plain_links(text, known):
    w = re.findall(r"[^\W_#]*(?:#[^\W_#]*)*", text.lower())
    w = [x for x in w if x]
    spans = [(i, n) for n in range(1, 5) for i in range(1, len(w) - n + 2) if " ".join(w[i - 1 : i - 1 + n]) in known]
    return {(i, n, e) for i, n in spans if not any(m > n and j <= i and j + m >= i + n for j, m in spans) for e in known[" ".join(w[i - 1 : i - 1 + n])]}


def test_links_equal_plain_search(spark):
    dice = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    known = {}
    while len(known) < 100_000:
        known.setdefault(" ".join(dice.choices(vocabulary, k=dice.choice([1, 2, 2, 3, 3, 4]))), {f"e{len(known)}"})
    known["t1"].add("second")
    texts = [(i, " ".join(dice.choices(vocabulary, k=60)).replace("t9", "T9,")) for i in range(60)] + [(60, ""), (61, None), (62, "T1")]
    aliases = spark.createDataFrame([(a, e) for a, es in known.items() for e in es], "alias string, entity string")
    found = linking.linked(spark.createDataFrame(texts, "id int, text string"), aliases).collect()
    for i, t in texts:
        assert {(r.start, r.length, r.entity) for r in found if r.id == i} == plain_links(t or "", known)
    codes = linking.coded(spark.createDataFrame([(1, "see B012345678 and B0ABCDEFGH, B012345678; xB0AAAAAAAA")], "id int, text string"), spark.createDataFrame([("B012345678", 9), ("B012345678", 4)], "code string, rank int"))
    assert {(r.code, r["rank"]) for r in codes.collect()} == {("B012345678", 4), ("B0ABCDEFGH", None)}


def test_slots(spark):
    hits = spark.createDataFrame([(1, d, d, "q", "x" * d) for d in range(1, 8)], "query int, doc int, rank int, question string, content string")
    assert [(r.doc, r.relevance) for r in slots.reranked(hits).orderBy("place").collect()] == [(d, pytest.approx(1 - 0.1 * (d - 1))) for d in range(1, 6)]
    longest = lambda a, b: [float(len(x)) for x in b]
    assert [r.doc for r in slots.reranked(hits, longest).orderBy("place").collect()] == [7, 6, 5, 4, 3]
    assert hits.where(slots.relevant(F.col("question"), F.col("content"))).count() == 7
    assert hits.where(slots.relevant(F.col("question"), F.col("content"), longest, 4)).count() == 4
    pair = spark.createDataFrame([("red box", "red bag"), ("", "!"), ("a1", None)], "a string, b string")
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    assert [r[0] for r in pair.select(slots.similarity(F.col("a"), F.col("b"), words)).collect()][:2] == [pytest.approx(1 / 3), 0.0]
    assert [r[0] for r in pair.select(slots.similarity(F.col("a"), F.col("b"), words, longest)).collect()] == [7.0, 1.0, 0.0]


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "v double, day string, id int")
    files = lambda day: sorted(glob.glob(f"{folder}/day={day}/*.parquet"))
    assert stored.upsert(rows((1.0, "a", 1), (2.0, "a", 2), (3.0, "b", 1), (4.0, "b", 1)), folder, ["day", "id"], "day") == 2
    before = files("a")
    assert stored.upsert(rows((9.0, "b", 1), (5.0, "b", 7)), folder, ["day", "id"], "day") == 1
    assert files("a") == before
    kept = [files("a"), files("b")]
    assert stored.upsert(rows((9.0, "b", 1), (1.0, "a", 1)), folder, ["day", "id"], "day") == 0
    assert [files("a"), files("b")] == kept
    assert {(r.day, r.id, r.v) for r in spark.read.parquet(folder).collect()} == {("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 9.0), ("b", 7, 5.0)}
    with pytest.raises(ValueError):
        stored.upsert(rows((1.0, "a", 1)), folder, ["id"], "day")


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "g")
    with pytest.raises(LookupError):
        stored.as_of(spark, folder)
    assert stored.commit(spark.range(3), folder, "one") == 1
    spark.range(99).write.parquet(f"{folder}/data/half-way")  # stopped before its manifest
    assert stored.as_of(spark, folder).count() == 3 and stored.versions(spark, folder).count() == 1
    assert stored.commit(spark.range(5), folder) == 2
    assert [stored.as_of(spark, folder, v).count() for v in (1, 2, None)] == [3, 5, 5]
    with pytest.raises(LookupError):
        stored.as_of(spark, folder, 7)


def test_figures_by_label(spark):
    text = ["Net Income: 1.5 billion. REVENUE: 1,234B; operating profit 7 Billion. Revenue fell -3.5% YoY", "profit of 9 billion", "Revenue: 2 million", None]
    out = spark.createDataFrame([(t,) for t in text], "t string").select(X.figures(F.col("t")).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in out] == [(1234.0, 7.0, 1.5, -3.5), (None,) * 4, (None,) * 4, (None,) * 4]


def test_guard_reads_look_alike_letters(spark):
    rows = spark.createDataFrame([("ｉｇｎｏｒｅ all",), ("Ignore ALL",), ("fine",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.guarded(F.col("t"), ("ignore all", "<script"))).collect()] == [False, False, True, True]
    assert [r[0] for r in rows.select(T.redacted(F.col("t"), ("ignore",))).collect()] == ["ｉｇｎｏｒｅ all", "[REDACTED] ALL", "fine", None]


def test_traces_hold_their_layers(spark):
    rows = plans.traces(spark, SF)
    assert dict(rows.dtypes)["trace"] == "variant"
    assert {r.turns for r in plans._layers(spark, SF).collect()} and plans.QUERIES["trace_scores"](spark, SF).where("violation_rate > 0").count()


def test_last_figures_of_a_stream(spark, tmp_path):
    """Files come in any order, one of them twice; 20 of 60 samples are kept."""
    from shelfloom.streaming import windows as W

    dice = random.Random(8)
    rows = [(dice.choice("ab"), float(dice.randrange(50)), i, dice.random()) for i in range(60)]
    dice.shuffle(rows)
    frame = lambda part: spark.createDataFrame(part, "k string, s double, i long, v double").select("k", F.timestamp_seconds("s").alias("at"), "i", "v").coalesce(1)
    for part in (rows[:20], rows[20:40], rows[20:40], rows[40:]):
        frame(part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {r.k: r for r in W.read_to_end(W.last_figures(stream, "k", "at", "i", "v", 20), ["k"], str(tmp_path / "out")).collect()}
    for k in "ab":
        last = sorted(v for _, _, v in sorted((s, i, v) for key, s, i, v in rows if key == k)[-20:])
        assert (out[k].n, out[k].mean, out[k].least, out[k].p50, out[k].p90) == (20, pytest.approx(sum(last) / 20), last[0], last[10], last[18])


def test_nearest_rows_by_blocks(spark, tmp_path, monkeypatch):
    """Blocks of rows and queries meet as matrices: no pair of a row and a query is a row of a plan; copies, zeros, nulls and other lengths as before."""
    dice = random.Random(6)
    base = [[dice.uniform(-1, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, base[dice.randrange(40)]) for i in range(900)] + [(900, None), (901, [0.0] * 8), (902, [1.0, 2.0]), (903, [1.0, None] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 100 < 4").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    length = lambda x: sum(c * c for c in x) ** 0.5
    usable = {i: x for i, x in rows if x and None not in x and length(x) > 0}

    def plain(q, only):
        near = {}
        for i, _ in rows:
            x, y = usable.get(q), usable.get(i)
            there = x is not None and y is not None and len(x) == len(y)
            if i != q and (there or not only):
                near[i] = sum(a * b for a, b in zip(x, y, strict=True)) / length(x) / length(y) if there else None
        return sorted(near, key=lambda i: (near[i] is None, -round(near[i] or 0, 6), i))[:10]

    monkeypatch.setattr(R, "ROW_BLOCK", 200)
    monkeypatch.setattr(R, "PIECE", 1000)
    found = R.vector_topk(asked, v, block=7)
    assert not re.search("NestedLoop|Cartesian", found._jdf.queryExecution().executedPlan().toString())
    index = VectorIndex.fit(v.where("vec_id < 900"), str(tmp_path / "v")).append(v.where("vec_id >= 900"))
    for rows_found, only in ((found, False), (index.search(asked), True)):
        got = {}
        for r in sorted(rows_found.collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query, []).append(r.vec_id)
        wanted = {q.query: plain(q.query, only) for q in asked.collect() if not only or len(usable.get(q.query, [])) == 8}
        assert got == wanted
    tags = v.select("vec_id", F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("t"), F.col("vec_id") % 3)).alias("tag"))
    sides = index.sides(asked, tags.withColumnRenamed("vec_id", "query"), tags, 1000).collect()
    every = {(q.query, i) for q in asked.collect() if len(usable.get(q.query, [])) == 8 for i, x in usable.items() if len(x) == 8 and i != q.query}
    assert {(r.query, r.vec_id, r.passes) for r in sides} == {(q, i, q % 3 == i % 3 > 0) for q, i in every}


def test_terms_are_handed_on_in_pieces():
    """A batch of many texts leaves its worker in several of few terms; the rows are the same."""
    texts = [f"one two{i} one x three" for i in range(50)] + ["", None]
    batch = pa.record_batch([pa.array(range(52)), pa.array(texts, pa.string())], ["doc", "text"])
    out = list(text_index._counting(10)(iter([batch, batch.slice(0, 0)])))
    assert max(len(b["terms"].flatten()) for b in out) <= 13 and len(out) > 10
    rows = {r["doc"]: (r["length"], {(t["term"], t["tf"]) for t in r["terms"]}) for b in out for r in b.to_pylist()}
    assert rows[12] == (5, {("one", 2), ("two", 1), ("12", 1), ("three", 1)}) and rows[3] == (4, {("one", 2), ("two", 1), ("three", 1)})
    assert len(rows) == 52 and rows[50] == rows[51] == (0, set())


def test_runs_outside_the_dictionary_stay_in_their_task(spark):
    """The sieve lets every alias through and hardly a run that is none; entities join once the covered runs are gone."""
    names = spark.range(2000).select(F.concat(F.lit("name "), "id").alias("alias"))
    bits = 1 << 15
    passing = lambda rows: rows.crossJoin(linking._sieve(names, bits)).where(linking._passes(F.col("alias"), bits)).count()
    assert passing(names) == 2000 and passing(spark.range(5000).select(F.concat(F.lit("other "), "id").alias("alias"))) < 250
    known = spark.createDataFrame([("red box", f"e{i}") for i in range(30)] + [("box", "b"), ("red", "r")], "alias string, entity string")
    texts = spark.createDataFrame([(1, "a red box, box"), (1, "a red box"), (2, "red")], "id int, text string")
    found = linking.linked(texts, known)
    assert {(r.id, r.start, r.length, r.alias, r.entity) for r in found.collect()} == {(1, 2, 2, "red box", f"e{i}") for i in range(30)} | {(1, 4, 1, "box", "b"), (2, 1, 1, "red", "r")}
    assert found.select("*")._jdf.queryExecution().executedPlan().toString().count("entity:string") == 1  # the relation that joins last


def test_blocks_hand_on_the_best_alone(spark, tmp_path, monkeypatch):
    """Many small blocks, copies and rows that share an id: the same as plain sums; of a block fewer than 2 k documents a question leave the task, but for shared ids."""
    import math
    from collections import Counter

    monkeypatch.setattr(text_index, "BLOCK_TERMS", 60)
    dice = random.Random(5)
    texts = [" ".join(dice.choices(["aa", "bb", "cc", "dd", "ee", "ff"], [9, 5, 3, 2, 1, 1], k=dice.choice([3, 8]))) for _ in range(40)]
    rows = [(f"d{i % 290}", dice.choice(texts)) for i in range(300)] + [("none", ""), (None, "aa bb")]
    index = TextIndex(spark, str(tmp_path / "i")).append(spark.createDataFrame(rows, "doc_id string, text string"), first=True)
    asked = index.asked(spark.createDataFrame([("p", "aa bb ff"), ("q", "cc")], "query string, text string"))
    blocks = index._read("docs").select("block").distinct().count()
    assert blocks > 8 and index.scores(asked, k=2).count() <= 2 * blocks * 2 * 2 + 2 * 10 < index.scores(asked).count()
    known = [(d, Counter(t.split())) for d, t in rows if d and t]
    mean, n = sum(c.total() for _, c in known) / len(known), len(known)
    for name, terms in (("p", ["aa", "bb", "ff"]), ("q", ["cc"])):
        plain = Counter()
        for d, c in known:
            for t in terms:
                df = sum(t in x for _, x in known)
                plain[d] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean))
        best = sorted((d for d in plain if plain[d]), key=lambda d: (-round(plain[d], 6), d))[:5]
        got = [r for r in index.search(spark.createDataFrame([("p", "aa bb ff"), ("q", "cc")], "query string, text string"), 5).orderBy("rank").collect() if r.query == name]
        assert [r.doc for r in got] == best and [r.score for r in got] == [pytest.approx(plain[d]) for d in best]
