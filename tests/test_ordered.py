"""Ordered exports and reports in parts, day sums, and the first of many names."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import ordered, render, search, telemetry
from codeloom.sources.tables import DAY_MS
from codeloom.streaming.rollup import DaySums


@pytest.fixture(scope="module", autouse=True)
def tasks_as_planned(spark):
    """Small data would go to one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    kinds = ["slice", "slice", "guard_check", "sandbox_run", None]
    rows = [
        (f"e{k}", rng.randrange(40 * DAY_MS), rng.choice(["cli", "mcp", None]), rng.choice(kinds), rng.choice(["a.ts", 'q"x\n.ts', None]), "f", rng.randrange(900), rng.randrange(300), rng.randrange(600), rng.choice([None, rng.randrange(50)]), rng.choice(["success", "violation", None]), k % 2, None)
        for k in range(500)
    ]
    return spark.createDataFrame([*rows, *rows[:3]], schemas.TELEMETRY).repartition(5)


def test_numbers_of_an_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("other")).repartition(7)
    got = ordered.numbered(rows, [F.desc("v")]).collect()
    assert sorted((r.row_no, r.v) for r in got) == [(k, 4999 - k) for k in range(5000)]
    assert ordered.numbered(rows.limit(0), [F.desc("v")]).count() == 0


def test_exports_of_any_size(spark, events, tmp_path):
    path = str(tmp_path / "csv")
    manifest = telemetry.export_parts(events, path)
    assert manifest["rows"] == 503 and len(manifest["files"]) > 1 and sum(f["rows"] for f in manifest["files"]) == 503
    text = "".join(ordered.put_together(spark, path))
    rows = list(csv.reader(io.StringIO(text)))
    assert rows[0] == telemetry.CSV_COLUMNS and sum(r == telemetry.CSV_COLUMNS for r in rows) == 1
    want = [(r.id, str(r.timestamp), r.file_path or "") for r in events.orderBy(F.desc("timestamp"), F.desc("id")).collect()]
    assert [(r[0], r[1], r[4]) for r in rows[1:]] == want
    newest = telemetry.export_parts(events, str(tmp_path / "json"), "json", limit=10)
    lines = "".join(ordered.put_together(spark, str(tmp_path / "json"))).splitlines()
    assert newest["rows"] == 10 and [json.loads(x)["id"] for x in lines] == [w[0] for w in want[:10]]
    assert telemetry.export_parts(events.limit(0), str(tmp_path / "none"))["rows"] == 0
    assert [r.row_no for r in telemetry.numbered_lines(events).orderBy("row_no").collect()] == list(range(503))


def test_reports_of_a_corpus(spark, tmp_path):
    found = spark.range(3000).select(F.concat(F.lit("src/f"), F.col("id") % 700).alias("source_file"), F.concat(F.lit('db"'), "id").alias("imported_module"), F.lit("R").alias("rule_name"), F.lit("no").alias("message")).repartition(6)
    rows = render.guard_document_rows(found, "w", 2)
    document = json.loads("".join(r.text for r in sorted(rows.collect(), key=lambda r: r.row_no)))
    assert document["status"] == "violations" and document["violations_count"] == 3000 == len(document["violations"])
    names = [v["source_file"] for v in document["violations"]]
    assert names == sorted(names)
    # No task holds more than its share.
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < 2000
    clean = json.loads("".join(r.text for r in sorted(render.guard_document_rows(found.limit(0), "w", 2).collect(), key=lambda r: r.row_no)))
    assert clean == {"status": "clean", "workspace": "w", "active_rules": 2, "violations_count": 0, "violations": []}
    render.write_guard_report(found, str(tmp_path / "md"), 700)
    lines = "".join(ordered.put_together(spark, str(tmp_path / "md"))).splitlines()
    assert lines[0] == "## Import check: 3000 import(s) cross a layer" and sum(x.startswith("| **R** |") for x in lines) == 3000


def test_day_sums_equal_a_scan(spark, events, tmp_path):
    sums, now = DaySums(spark, str(tmp_path / "sums"), buckets=4), 40 * DAY_MS - DAY_MS // 3
    for batch in (0, 1, 1, 2, 3, 4, 4):
        sums.add(events.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == batch), batch)
    row = lambda frame: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect()]
    for window in telemetry.TimeWindow:
        assert row(sums.summary(events, window, now)) == row(telemetry.summary(events, window, now))
        want = telemetry.client_breakdown(telemetry.in_window(events, window, now))
        assert sorted(row(sums.client_breakdown(events, window, now)), key=repr) == sorted(row(want), key=repr)
    for days in (1, 9, 100):
        assert row(sums.daily_velocity(events, days, now)) == row(telemetry.daily_velocity(events, days, now))
    # Of the events only those of the day that a window cuts are read again.
    start = telemetry.TimeWindow.LAST_7D.start_ms(now)
    again = sums.since(events, start).subtract(sums.table.read())
    assert again.agg(F.max("day") - F.min("day")).first()[0] == 0 and sums.since(events, 3 * DAY_MS).filter("day < 3").count() == 0
    assert row(DaySums(spark, str(tmp_path / "none")).summary(events.limit(0))) == row(telemetry.summary(events.limit(0)))


def plain_first(questions, names):
    names = sorted((o, n) for o, n in names if n is not None)
    out = []
    for k, q in questions:
        hit = [n for _, n in names if q is not None and n.lower() in q.lower()]
        out.append((k, hit[0] if hit else names[0][1]))
    return sorted(out)


def test_the_first_of_many_names(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdeÉ") for _ in range(n))
    names = [(k, word(rng.randrange(1, 7))) for k in range(5, 400)] + [(900, None)]
    questions = [(k, " ".join(word(rng.randrange(1, 6)) for _ in range(rng.randrange(0, 9)))) for k in range(150)] + [(500, None), (501, ""), (502, "zzz"), (503, "zzz"), (504, "abc" * 3000)]
    asked = spark.createDataFrame(questions, "k int, question string").repartition(3)
    for some in (names, names[300:], [*names[300:], (650, ""), (2, "")]):
        table = spark.createDataFrame(some, "ord int, name string")
        got = search.first_named(asked, table)
        assert got.columns == ["k", "question", "symbol"]
        assert sorted((r.k, r.symbol) for r in got.collect()) == plain_first(questions, some)
    assert search.first_named(asked.limit(0), table).count() == 0
def test_later_names_meet_only_questions_without_an_earlier_one(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    names = [(k, word(2) if k % 2 else "".join(rng.choice("mnopq") for _ in range(9))) for k in range(600)]
    questions = [(k, " ".join(word(6) for _ in range(30))) for k in range(200)] + [(500 + k, "zz " + names[400 + 2 * k][1].upper() + "x") for k in range(20)] + [(900, "zzzz")]
    met, holding = [], search.holding

    def counted(texts, words):
        met.append((texts.count(), words.count()))
        return holding(texts, words)

    monkeypatch.setattr(search, "holding", counted)
    asked = spark.createDataFrame(questions, "k int, question string").repartition(3)
    for some, texts in ((names, 60), ([*names, (200, "")], 60), ([*names, (30, "")], None)):
        met.clear()
        got = search.first_named(asked, spark.createDataFrame(some, "ord int, name string"))
        assert sorted((r.k, r.symbol) for r in got.collect()) == plain_first(questions, sorted(some))
        assert met == [] if texts is None else 20 <= met[0][0] < texts


