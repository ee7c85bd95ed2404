"""Numbered lines over blocks of files, and the readers on top of them."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import phone
from tidemark.sources import readers
from tidemark.sources.lines import number_lines, numbered_lines, placed_lines, write_lines


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_numbers_over_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(5)
    want, seq = [], 0
    for name in ("a.txt", "b.txt", "c/x.txt"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        lines = ["" if rng.random() < 0.2 else "é" * rng.randint(1, 90) + str(k) for k in range(rng.choice([1, 150, 400]))]
        path.write_text("\n".join(lines) + rng.choice(["", "\n"]), encoding="utf-8")
        lines = path.read_text().split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        want += [(name, k, seq + k, v) for k, v in enumerate(lines, 1)]
        seq += len(lines)
    raw = spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "in"))
    assert raw.rdd.getNumPartitions() > 5
    got = number_lines(placed_lines(raw)).collect()
    assert sorted((r.file.split("/in/")[1], r.line, r.seq, r.value) for r in got) == sorted(want)


def test_written_lines_come_back_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, 100 - k, f"v{k}") for k in range(60)], "part long, o long, value string").repartition(7)
    write_lines(rows, str(tmp_path / "out"), "part", ["o"], header="h")
    got = numbered_lines(spark, str(tmp_path / "out")).orderBy("part", "line").collect()
    assert [(r.part, r.line, r.value) for r in got] == [(p, n, v) for p in range(3) for n, v in enumerate(["h", *(f"v{k}" for k in range(59, -1, -1) if k % 3 == p)], 1)]
    assert [r.seq for r in sorted(got, key=lambda r: (r.part, r.line))] == list(range(1, 64))
    assert numbered_lines(spark, str(tmp_path / "out")).filter("line = 1").count() == 3


def test_ties_follow_lines(spark, tmp_path, small_blocks):
    row = lambda clock, event: '{"timestamp":"2026-08-01T%s+03:00","event":"%s"}' % (clock, event)  # noqa: E731, UP031
    rows = [row("09:00:00", "SCREEN_INTERACTIVE"), "", row("09:00:05", "KEYGUARD_HIDDEN"), row("09:02:00", "DEVICE_SHUTDOWN")]
    rows += ["\t"] * 40 + [row("09:20:00", "SCREEN_INTERACTIVE"), row("09:20:00", "KEYGUARD_HIDDEN"), row("09:30:00", "KEYGUARD_SHOWN"), row("09:30:00", "KEYGUARD_HIDDEN"), row("09:30:00", "DEVICE_STARTUP"), row("09:35:00", "KEYGUARD_SHOWN")]
    (tmp_path / "p.jsonl").write_text("\n".join(rows))
    log = readers.read_phone_jsonl(spark, str(tmp_path / "p.jsonl"))
    spans = sorted((str(r.start_timestamp)[11:], str(r.end_timestamp)[11:]) for r in phone.active_intervals(log.rows.drop("file", "line")).collect())
    assert spans == [("09:00:05", "09:02:00"), ("09:30:00", "09:35:00")]


def test_rejected_lines(spark, tmp_path):
    rows = ['{"timestamp":"2026-08-01T09:00:00","event":"SCREEN_INTERACTIVE"}', "[1]", '{"event":"SCREEN_INTERACTIVE"}', '{"timestamp":"x","event":"OTHER"}', '{"timestamp":"2026-08-01"}', "{", '{"timestamp":"x","event":"KEYGUARD_SHOWN"}']
    (tmp_path / "p.jsonl").write_text("\n".join(rows))
    log = readers.read_phone_jsonl(spark, str(tmp_path / "p.jsonl"))
    assert sorted((r.line, r.reason) for r in log.rejected.collect()) == [(2, "json"), (3, "timestamp"), (5, "event"), (6, "json"), (7, "timestamp")]
    assert [(r.line, r.event) for r in log.rows.collect()] == [(1, "SCREEN_INTERACTIVE")]
    assert [(r.event, r.ignored) for r in log.ignored.collect()] == [("OTHER", 1)]
    with pytest.raises(Exception, match=r"p\.jsonl, line [2-7]: "):
        readers.read_phone_jsonl(spark, str(tmp_path / "p.jsonl"), strict=True).rows.collect()
    (tmp_path / "a.csv").write_text('timestamp,event,task\n\n2026-08-01 09:00:00,start,"Work, big: Code"\n2026-08-01 10:00:00,jump,x\n2026-08-01 10:00:00,end\n')
    good, bad = readers.read_embed_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.line, r.category, r.name) for r in good.collect()] == [(3, "Work, big", "Code")]
    assert sorted((r.line, r.reason, r.value) for r in bad.collect()) == [(4, "event", "2026-08-01 10:00:00,jump,x"), (5, "task", "2026-08-01 10:00:00,end")]
    with pytest.raises(Exception, match=r"a\.csv, line [45]: "):
        readers.read_embed_csv(spark, str(tmp_path / "a.csv"), strict=True)[0].collect()


def test_plan_shuffles_no_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a\nb\n")
    df = numbered_lines(spark, str(tmp_path / "a.txt")).filter(F.col("line") > 1)
    assert [r.value for r in df.collect()] == ["b"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0]
