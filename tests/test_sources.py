"""Text sources and the suppression of repeated events on a stream."""

import datetime
import glob
import json
import random
import re

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfloom.sources import files
from shelfloom.streaming import suppression


def test_line_numbers_over_blocks(spark, tmp_path):
    """Small blocks: a file is read by many tasks, and its lines are still numbered from its begin."""
    dice, wanted = random.Random(4), {}
    for name in ("a", "b"):
        lines = []
        for i in range(400):
            lines.append(dice.choice([json.dumps({"id": f"{name}{i}", "question": "x" * dice.randrange(60)}), "# note", "", "   ", '{"id": "cut', "[1]", "word", "7", json.dumps({"id": f"{name}{i}"})]))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        for n, line in enumerate(lines, 1):
            if line.strip() and not line.startswith("#"):
                try:
                    fine = isinstance(json.loads(line), dict)
                except ValueError:
                    fine = False
                wanted[name, n] = (json.loads(line)["id"], None) if fine else (None, line.strip())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.json_lines(spark, str(tmp_path), "id string, question string")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(re.search(r"(\w)\.jsonl", r.file)[1], r.number): (r.item and r.item.id, r.bad) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == wanted


def test_line_problems(spark, tmp_path):
    lines = ['{"id": "a", "question": "q"}', '{"id": "a", "question": "q"}', '{"id": " ", "question": "q"}', '{"question": "q"}', '{"id": "b", "question": " "}', '{"id": "a"}', "{", '{"id": "c", "question": "q", "more": 1}', '{"id": ["d"], "question": "q"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = files.line_problems(files.json_lines(spark, str(tmp_path), "id string, question string"), "id", "question")
    found = {(r.number, r.problem) for r in rows.collect()}
    assert found == {(2, "repeated key"), (3, "no key"), (4, "no key"), (5, "empty field"), (6, "repeated key"), (6, "empty field"), (7, "broken line")}


def test_records_by_day(spark, tmp_path):
    folder, day = str(tmp_path / "r"), datetime.date
    frame = lambda *rows: spark.createDataFrame(list(rows), "snapshot_date date, rank int, badges array<string>")
    files.save_records(frame((day(2024, 1, 1), 1, ["x"]), (day(2024, 1, 5), 1, None), (day(2024, 1, 5), 2, [])), folder)
    old = glob.glob(f"{folder}/snapshot_date=2024-01-01/*.json")
    files.save_records(frame((day(2024, 1, 5), 7, ["y", "z"])), folder)
    assert glob.glob(f"{folder}/snapshot_date=2024-01-01/*.json") == old
    schema = StructType.fromDDL("snapshot_date date, rank int, badges array<string>")
    assert [(r["rank"], r.badges) for r in files.recent_records(spark, folder, schema, day(2024, 1, 6), 2).collect()] == [(7, ["y", "z"])]
    every = files.recent_records(spark, folder, schema, day(2024, 1, 6), 5)
    assert {r["rank"] for r in every.collect()} == {1, 7} and "PartitionFilters: [isnotnull(snapshot_date" in every._jdf.queryExecution().executedPlan().toString()


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('snapshot_date,asin,brand,product_name\n2024-01-01,A,Tree,"Scrub, ""big"""\n2024-01-02,B,other,New TREE HUT jar\n2024-01-02,C,\n2024-01-03,D,tree,x\n2024-01-02,E,Clean,y\n')
    columns = ["snapshot_date", "asin", "brand", "product_name"]
    rows = files.sheet(spark, str(tmp_path), columns, "2024-01-01", "2024-01-02")
    assert {(r.asin, r.brand, r.product_name) for r in rows.collect()} == {("A", "Tree Hut", 'Scrub, "big"'), ("B", "Tree Hut", "New TREE HUT jar"), ("C", "", ""), ("E", "Clean Skin Club", "y")}
    some = files.sheet(spark, str(tmp_path), columns, "2024-01-01", "2024-01-09", "tree hut", F.col("asin") > "A")
    assert {r.asin for r in some.collect()} == {"B", "D"}
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(asin,A\)", plan) and "LessThanOrEqual(snapshot_date,2024-01-09)" in plan


def plain(events, seconds, most):
    """Suppression one event at a time."""
    opened, out = {}, set()
    for at, number, key in sorted({(a, n, k) for k, a, n in events}):
        first, count = opened.get(key, (None, 0))
        if first is None or at - first > seconds:
            first, count = at, 0
        opened[key] = (first, count + 1)
        over = max(0, count + 1 - most)
        if over <= 1 or over % 10 == 0:
            out.add((key, number, over))
    return out


def test_suppression_on_a_stream(spark, tmp_path):
    """Events out of order within ten seconds, some twice and after their time; one far too late; without key or time."""
    dice = random.Random(3)
    events = [(dice.choice("aab"), 1000.0 + i // 3, i) for i in range(600)]  # a watermark begins at 1970
    shaken = sorted(events, key=lambda e: e[1] + dice.uniform(0, 9))
    parts = [shaken[i : i + 150] for i in range(0, 600, 150)]
    parts[2] += parts[0][:40] + [("b", 1001.0, 9999)]  # read again, and too late: the watermark is past them
    parts[1] += [(None, 1070.0, 1), ("a", None, 2)]
    for p in [*parts, [("end", 9999.0, 0)]]:
        spark.createDataFrame(p, "k string, s double, n long").select("k", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"), "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = suppression.appended(suppression.suppressed(stream, "k", "at", "n", 20, 3, "12 seconds"), str(tmp_path / "out")).collect()
    assert len(rows) == len({(r.k, r.n) for r in rows})
    assert {(r.k, r.n, r.suppressed) for r in rows} == plain(events, 20, 3)


def test_waiting_events_are_packed(spark, tmp_path):
    """One value for what a batch has of a stretch of time, not one for an event; windows longer and shorter than a batch."""
    dice = random.Random(5)
    events = [("a", 1000.0 + dice.randrange(4000) / 4, i) for i in range(6000)]
    for i in range(0, 6000, 2000):
        spark.createDataFrame(events[i : i + 2000] + events[:50], "k string, s double, n long").select("k", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"), "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", 99999.0, 0)], "k string, s double, n long").select("k", F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("at"), "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, at timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = suppression.suppressed(stream, "k", "at", "n", 20, 3, "2 hours")
    rows = suppression.appended(found, str(tmp_path / "out")).collect()
    assert len(rows) == len({(r.k, r.n) for r in rows}) and {(r.k, r.n, r.suppressed) for r in rows} == plain(events, 20, 3)
    held = spark.read.format("statestore").option("path", glob.glob(str(tmp_path / "out/state-*"))[0]).option("stateVarName", "waiting").option("batchId", 2).load()
    assert 0 < held.count() < 60


def test_tasks_of_sales_do_not_grow(spark, monkeypatch):
    """Sales are dealt by product to as many tasks as their rows ask for, and counted there: no second exchange by product."""
    from shelfloom.plans import registry
    from shelfloom.sources import tables, views

    folder = "/root/testdata/sf0.001"
    rows = lambda name: sorted(map(str, registry.queries()[name](spark, folder).collect()))
    whole = {n: rows(n) for n in ("category_kpi", "monthly_brands")}
    monkeypatch.setattr(tables, "TASK_ROWS", 500)
    sold = views.sold_rows(spark, folder)
    for name in whole:
        df = registry.queries()[name](spark, folder)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f", {-(-sold // 500)}), REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning(l_partkey") == plan.count("REPARTITION_BY_NUM") and rows(name) == whole[name]
