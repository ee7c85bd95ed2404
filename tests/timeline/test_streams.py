"""Streams against their batch forms on the same files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import build, intervals
from tidemark.plans.queries import QUERIES
from tidemark.sources import adapter
from tidemark.streaming import streams
from tidemark.streaming.stateful import fold

SF = "/root/testdata/sf0.001"


def write_files(spark, path, rows, parts):
    df = spark.createDataFrame(rows, streams.EVENTS)
    for k in range(parts):  # one file after the other, in time order
        df.filter(F.col("id") % 1_000_000 * parts / len(rows) >= k).filter(F.col("id") % 1_000_000 * parts / len(rows) < k + 1).coalesce(1).write.mode("append").parquet(path)


def made(n=400):
    rng = random.Random(3)
    t0 = datetime(2026, 1, 1)
    return [(rng.randrange(2), i, t0 + timedelta(minutes=7 * i), "pc", rng.choice(["interval_start", "interval_end"]), "c", rng.choice("ab")) for i in range(n)]


def pairs(chunks):
    return sorted((r.tenant_id, r.start_event_id, r.end_event_id) for r in chunks.collect())


def batch_build(spark, rows):
    return build.build(spark.createDataFrame(rows, streams.EVENTS).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


def micro_batches(spark, path, rows, lag, share=0.1, parts=6):
    """Files in time order; some rows come `lag` files later."""
    rng = random.Random(7)
    files = [[] for _ in range(parts)]
    for k, r in enumerate(rows):
        at = k * parts // len(rows)
        files[min(parts - 1, at + lag * (rng.random() < share))].append(r)
    for rows_of_file in files:
        spark.createDataFrame(rows_of_file, streams.EVENTS).coalesce(1).write.mode("append").parquet(path)


def run_chunks(spark, path):
    return streams.run_stateful(streams.stream_build_chunks(streams.event_stream(spark, path, files_per_trigger=1)), "test")


def waiting_rows(spark, state):
    """Ids of the events in the state: those that the watermark has not passed."""
    return {r[0] for r in spark.read.format("statestore").option("path", state).option("stateVarName", "waiting").load().select("list_element.id").collect()}


def test_stream_steps_equal_batch(spark, tmp_path):
    """Without late events the stream gives what the batch build gives, warnings included, up to where the watermark came."""
    rows = made()
    write_files(spark, str(tmp_path / "in"), rows, 4)
    steps, state = run_chunks(spark, str(tmp_path / "in"))
    waiting = waiting_rows(spark, state)
    assert 0 < len(waiting) < 150
    want = sorted((r.tenant_id, r.kind, r.start_event_id, r.end_event_id) for r in batch_build(spark, rows).collect() if r.kind != "unclosed" and not waiting & {(r.start_event_id if r.end_event_id is None else r.end_event_id)})
    got = sorted((r.tenant_id, r.kind, r.start_event_id, r.end_event_id) for r in steps.collect())
    plain = lambda found: sorted((t, k, e if k in ("mismatch", "orphan_end") else s, None if k in ("mismatch", "orphan_end") else e) for t, k, s, e in found)
    assert plain(got) == plain(want) and len(got) > 200


def test_late_events_are_repaired(spark, tmp_path):
    rows = made()
    micro_batches(spark, str(tmp_path / "in"), rows, lag=3)
    steps, state = run_chunks(spark, str(tmp_path / "in"))
    late = steps.filter("kind = 'late'").count()
    assert late > 5
    chunks = streams.with_tail(steps, spark.createDataFrame(rows, streams.EVENTS))
    want = pairs(build.chunks_of(batch_build(spark, rows)))
    assert pairs(chunks) == want and pairs(steps.filter("kind = 'chunk'")) != want
    # what waits in the state is what the watermark has not passed
    assert 0 < len(waiting_rows(spark, state)) < 150


def test_states_are_shared_by_tenants(spark, tmp_path):
    """A state holds some tenants' keys, each with its own machine; a null source is a key, too."""
    t0 = datetime(2026, 1, 1)
    rng = random.Random(8)
    rows = [(t, k * 40 + t, t0 + timedelta(hours=k), rng.choice(["pc", None]), "interval_start" if k % 2 == 0 else "interval_end", "c", "a") for k in range(20) for t in range(40)]
    micro_batches(spark, str(tmp_path / "in"), rows, lag=0, parts=4)
    steps, state = run_chunks(spark, str(tmp_path / "in"))
    groups = spark.read.format("statestore").option("path", state).option("stateVarName", "reached").load().select("key").distinct().count()
    assert 0 < groups <= 3
    assert pairs(streams.with_tail(steps, spark.createDataFrame(rows, streams.EVENTS))) == pairs(build.chunks_of(batch_build(spark, rows)))


def test_fold_in_any_cut():
    rng = random.Random(2)
    events = [(k, k % 7, rng.random() < 0.5, "c", rng.choice("ab")) for k in range(300)]
    idle = (-1, 0, False, None, None, None, None)
    whole, end = fold(events, idle)
    steps, state, at = [], idle, 0
    while at < len(events):
        n = rng.randint(1, 40)
        some, state = fold(events[at : at + n], state)
        steps, at = steps + some, at + n
    assert (steps, state) == (whole, end) and {s[0] for s in whole} == {"chunk", "duplicate_start", "orphan_end", "mismatch"}
    assert fold([(5, 1, True, "c", "a")], (5, 1, False, None, None, None, None))[0] == [("late", 1, 5, None, None, "c", "a")]


def test_stream_import_drops_repeats(spark, tmp_path):
    rows = made(100)
    again = [(*r[:1], r[1] + 1_000_000, *r[2:]) for r in rows[::3]]
    write_files(spark, str(tmp_path / "in"), rows + again, 1)
    got = streams.run_available(streams.stream_import(streams.event_stream(spark, str(tmp_path / "in"))), "test")
    assert got.count() == 100


def test_stream_totals(spark, tmp_path):
    """Days close as the watermark passes and leave the state; late parts stand apart; all of it is the batch result."""
    t0 = datetime(2026, 1, 1, 23)
    spans = [(t0 + timedelta(days=i), t0 + timedelta(days=i, hours=2), name) for i in range(12) for name in "ab"]
    late = [(t0 + timedelta(hours=-3), t0 + timedelta(hours=-1), "a"), (t0 + timedelta(days=2), t0 + timedelta(days=2, hours=30), "b")]
    files = [spans[:8], spans[8:16], [*spans[16:], *late]]
    schema = "start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, name string"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closed, state = streams.run_stateful(streams.stream_period_totals(stream), "test")
    kinds = {r.kind: r.n for r in closed.groupBy("kind").agg(F.sum("parts").alias("n")).collect()}
    assert kinds["late"] >= 2 and kinds["final"] > 20
    opened = streams.open_totals(spark, state)
    newest = max(r[0] for r in spans)
    assert {r.start.date() for r in opened.collect()} <= {(newest - timedelta(days=k)).date() for k in (-1, 0, 1)}
    want = {(r.d, r.name): (r.s, r.n) for r in intervals.split(spark.createDataFrame(sum(files, []), schema), "day").groupBy(F.to_date("start_timestamp").alias("d"), "name").agg(F.sum("duration_seconds").alias("s"), F.count("*").alias("n")).collect()}
    every = closed.unionByName(opened).groupBy(F.to_date("start").alias("d"), "name").agg(F.sum("total_seconds").alias("s"), F.sum("parts").alias("n"))
    assert {(r.d, r.name): (r.s, r.n) for r in every.collect()} == want


def test_import_of_files_once_each(spark, tmp_path, monkeypatch):
    """A run that fails behind its writes, a restart, new files, and a file that repeats old rows."""
    folder, target = tmp_path / "in", str(tmp_path / "out")
    (folder / "log=3").mkdir(parents=True)
    line = lambda k, word="start": f"2026-08-0{1 + k // 20} {k % 20:02}:00:00,{word},Work: x{k}"
    write = lambda name, rows: (folder / "log=3" / name).write_text("\n".join(["timestamp,event,task", *rows]) + "\n")
    run = lambda: streams.import_tracker_files(spark, str(folder), target, tenant_id=F.col("log"), folders="log long", files_per_trigger=1)
    keys = lambda: sorted((r.tenant_id, str(r.timestamp), r.name, r.event_kind) for r in streams.imported_events(spark, target).collect())
    write("a.csv", [line(0), line(0), "", "nonsense", line(1, "end")])
    run()
    write("b.csv", [line(1, "end"), line(25), line(26)])
    real = streams._write_batch

    def fails(*args):
        real(*args)
        raise RuntimeError("after the writes")

    monkeypatch.setattr(streams, "_write_batch", fails)
    with pytest.raises(Exception, match="after the writes"):
        run()
    monkeypatch.setattr(streams, "_write_batch", real)
    run()
    write("c.csv", [line(26), line(27), line(0)])
    run()
    run()
    want = [(3, "2026-08-01 00:00:00", "x0", "interval_start"), (3, "2026-08-01 01:00:00", "x1", "interval_end"), *((3, f"2026-08-02 {h:02}:00:00", f"x{20 + h}", "interval_start") for h in (5, 6, 7))]
    assert keys() == want
    rejected = streams.rejected_lines(spark, target).collect()
    assert [(r.file.split("/")[-1], r.line, r.reason) for r in rejected] == [("a.csv", 5, "timestamp")]
    ids = [r.id for r in streams.imported_events(spark, target).collect()]
    assert len(set(ids)) == len(ids)


def test_many_small_logs_are_few_batches(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"logs/log={k}").mkdir(parents=True)
        (tmp_path / f"logs/log={k}/a.csv").write_text(f"timestamp,event,task\n2026-01-01 10:00:0{k % 10},start,a\nsoon,end,a\n")
    target = str(tmp_path / "target")
    streams.import_tracker_files(spark, str(tmp_path / "logs"), target, tenant_id=F.col("log"), folders="log long")
    assert streams.imported_events(spark, target).count() == streams.rejected_lines(spark, target).count() == 20
    assert len(list((tmp_path / "target/events").glob("batch=*"))) == 1


def test_r2_has_all_chunks(spark):
    columns = [c.split()[0] for c in streams.CHUNKS.split(", ")]
    want = build.chunks_of(build.build(adapter.events(spark, SF))).select(*[F.col(c).cast(t) for c, t in (x.split() for x in streams.CHUNKS.split(", "))])
    got = QUERIES["r2_stream_build_chunks"](spark, SF).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 50


def test_r3_has_all_days(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    spans = e.select(F.col("ts").alias("start_timestamp"), F.timestamp_add("MINUTE", F.floor("value").cast("int"), F.col("ts")).alias("end_timestamp"), F.col("event_type").alias("name"))
    want = intervals.split(spans, "day").groupBy(F.to_date("start_timestamp").alias("day"), "name").agg(F.sum("duration_seconds").alias("s"), F.count("*").alias("n"))
    got = QUERIES["r3_stream_period_totals"](spark, SF)
    assert sorted((r.start.date(), r.name, r.total_seconds, r.parts) for r in got.collect()) == sorted(map(tuple, want.collect()))
