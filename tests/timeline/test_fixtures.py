"""Small hand-made cases of the timeline operators with known results."""

import random
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import build, days, filters, goals, intervals, merge, phone, stats, validate
from tidemark.operators.filters import TimelineQuery
from tidemark.plans.timeline import Timeline
from tidemark.sources import readers

EVENTS = "tenant_id long, id long, timestamp timestamp_ntz, device_source string, event_kind string, category string, name string, revision long"
CHUNKS = "tenant_id long, id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, category string, name string, source string"
LOG = "tenant_id long, seq long, ts timestamp_ntz, event string"


def at(clock, day=1):
    h, m, s = ([*map(int, clock.split(":"))] + [0, 0])[:3]
    return datetime(2026, 8, day, h, m, s)


def events_of(spark, rows):
    kinds = {"S": "interval_start", "E": "interval_end", "P": "point"}
    return spark.createDataFrame([(0, i, at(c), source, kinds[k], "Work", name, 1) for i, (source, k, name, c) in enumerate(rows)], EVENTS)


def chunks_of(spark, rows):
    df = spark.createDataFrame([(0, i, s, e, c, n, src) for i, (s, e, c, n, src) in enumerate(rows)], CHUNKS)
    return df.withColumn("duration_seconds", F.timestamp_diff("SECOND", F.col("start_timestamp"), F.col("end_timestamp")))


def built(spark, rows):
    b = build.build(events_of(spark, rows)).cache()
    return [(r.name, r.start_timestamp, r.end_timestamp) for r in build.chunks_of(b).collect()], sorted(r.kind for r in build.warnings_of(b).collect())


def test_builder(spark):
    assert built(spark, [("pc", "S", "Code", "09"), ("pc", "S", "Meeting", "10"), ("pc", "E", "Code", "11")]) == ([("Code", at("09"), at("11"))], ["duplicate_start"])
    assert built(spark, [("pc", "S", "Code", "09"), ("pc", "E", "Meeting", "10"), ("pc", "E", "Code", "11")]) == ([("Code", at("09"), at("11"))], ["mismatch"])
    chunks, warned = built(spark, [("pc", "S", "Code", "09"), ("phone", "S", "Walk", "09"), ("pc", "E", "Code", "10"), ("phone", "E", "Walk", "10")])
    assert len(chunks) == 2 and warned == []
    assert built(spark, [("pc", "E", "Code", "09"), ("pc", "S", None, "10"), ("pc", "E", None, "11"), ("pc", "S", "x", "12")]) == ([(None, at("10"), at("11"))], ["orphan_end", "unclosed"])
    assert built(spark, []) == ([], [])


def one_pass(rows):
    """The state machine row by row: (kind, start id, end id, label, label of the open interval)."""
    state, out = None, []
    for r in rows:
        label = (r[5], r[6])
        if r[4] == "interval_start":
            if state is None:
                state = (r[1], label)
            else:
                out.append(("duplicate_start", r[1], None, label, state[1]))
        elif state is None:
            out.append(("orphan_end", None, r[1], label, (None, None)))
        elif state[1] != label:
            out.append(("mismatch", state[0], r[1], label, state[1]))
        else:
            out.append(("chunk", state[0], r[1], label, state[1]))
            state = None
    return out + ([("unclosed", state[0], None, state[1], (None, None))] if state else [])


@pytest.mark.parametrize("bucket, portion", [(1_000, 200_000), (1, 1), (3, 7), (50, 20)])
def test_builder_over_many_buckets_equals_one_pass(bucket, portion):
    """The three steps over streams cut anywhere, against one pass."""
    rng = random.Random(bucket)
    rows = []
    for i in range(2000):
        t = datetime(2026, 1, 1 + i // 120, rng.randrange(24), rng.randrange(60))
        rows.append((rng.randrange(3), i, t, rng.choice(["pc", "pc", None]), rng.choice(["interval_start", "interval_end"]), rng.choice(["c", None, None]), rng.choice("abcdef" if i > 900 else "ab"), 1))
    rows.append((9, 5000, rows[0][2], "pc", "interval_start", None, None, 1))
    key = lambda r: (r[0], r[3] or "", r[2], r[1])
    want, ordered = [], sorted(rows, key=key)
    for tenant in (0, 1, 2, 9):
        for source in ("pc", None):
            want += [(tenant, source, *x) for x in one_pass([r for r in ordered if (r[0], r[3]) == (tenant, source)])]
    table = pa.table({"tenant_id": [r[0] for r in ordered], "source": [r[3] for r in ordered], "day": [r[2].date() for r in ordered], "ts": pa.array([r[2] for r in ordered], pa.timestamp("us")), "id": [r[1] for r in ordered], "is_start": [r[4] == "interval_start" for r in ordered], "category": [r[5] for r in ordered], "name": [r[6] for r in ordered]})
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(build, "BUCKET", bucket)
        patch.setattr(build, "PORTION", portion)
        buckets = pa.Table.from_batches(build._effects(iter(table.to_batches(max_chunksize=64))))
        entries = pa.Table.from_batches(build._entries(iter(buckets.to_batches(max_chunksize=17))))
        keys = ["tenant_id", "source", "day", "part"]
        assert len({tuple(r.values()) for r in entries.select(keys).to_pylist()}) == buckets.num_rows
        entered = {tuple(r[k] for k in keys): r for r in entries.to_pylist()}
        rows_of = [entered[tuple(r[k] for k in keys)] for r in buckets.select(keys).to_pylist()]
        both = buckets.append_column("entry", pa.array([r["entry"] for r in rows_of], build._STATE_TYPE)).append_column("final", pa.array([r["final"] for r in rows_of]))
        got = [r for b in build._results(iter(both.combine_chunks().to_batches(max_chunksize=29))) for r in b.to_pylist()]
    found = [(r["tenant_id"], r["source"], r["kind"], r["start_event_id"], r["end_event_id"], (r["category"], r["name"]), (r["open_category"], r["open_name"])) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str) and {w[2] for w in want} == {"chunk", "duplicate_start", "orphan_end", "mismatch", "unclosed"}
    when = {r[1]: r[2] for r in rows}
    assert all((r["start_event_id"] is None or r["start_timestamp"] == when[r["start_event_id"]]) and (r["end_event_id"] is None or r["end_timestamp"] == when[r["end_event_id"]]) for r in got)


def test_clip_and_split(spark):
    c = chunks_of(spark, [(at("23:55"), at("08:00", 2), "Body", "Sleep", "embed")])
    q = TimelineQuery()
    assert [r.duration_seconds for r in q.day("2026-08-02").clipped(c).collect()] == [28800]
    assert [r.duration_seconds for r in q.day("2026-08-01").clipped(c).collect()] == [300]
    assert [r.duration_seconds for r in q.day("2026-08-01").persisted(c).collect()] == [29100]
    assert q.day("2026-08-02").persisted(c).count() == 0
    parts = intervals.split(chunks_of(spark, [(at("23:55"), at("01:00", 2), "a", "b", "pc"), (at("10"), at("10"), "a", "zero", "pc"), (at("09"), at("00", 2), "a", "edge", "pc")]), "day")
    assert sorted((r.name, r.duration_seconds) for r in parts.collect()) == [("b", 300), ("b", 3600), ("edge", 54000)]


def screen_case(spark, activity, screen):
    c = chunks_of(spark, [(*activity, "Work", "Working", "embed"), (*screen, "Screen", "Screen on", "phone")])
    return c.filter("source = 'embed'"), c.filter("source = 'phone'")


def test_intersection(spark):
    a, s = screen_case(spark, (at("09"), at("10")), (at("09:15"), at("09:45")))
    r = intervals.intersect(a, s).first()
    assert (r.activity_seconds, r.overlap_seconds, r.remainder_seconds, r.screen_seconds, r.overlap_percent) == (3600, 1800, 1800, 1800, 50.0)
    a, s = screen_case(spark, (at("23:30"), at("00:30", 2)), (at("23:45"), at("00:15", 2)))
    assert [(r.activity_seconds, r.overlap_seconds, r.overlap_percent) for r in intervals.intersect_over_time(a, s, "day").collect()] == [(1800, 900, 50.0)] * 2
    q = TimelineQuery().day("2026-08-01")
    a, s = screen_case(spark, (at("23:55"), at("00:20", 2)), (at("00:10", 2), at("00:30", 2)))
    assert intervals.intersect(q.clipped(a), q.clipped(s)).first().overlap_seconds == 0
    assert intervals.scoped(a, q, []).count() == 0


def test_subtract_against_brute_force(spark):
    rng = random.Random(8)
    span = lambda: (lambda s: (at("00", 1) .replace(day=1 + s // 24, hour=s % 24), s))(rng.randrange(0, 90))
    base, block = [], []
    for out, n in ((base, 15), (block, 20)):
        for _ in range(n):
            (s, a), length = span(), rng.randrange(0, 40)
            e = a + length
            out.append((s, at("00", 1).replace(day=1 + e // 24, hour=e % 24), "c", "n", "pc"))
    left = intervals.subtract(chunks_of(spark, base), chunks_of(spark, block))
    hours = lambda s, e: set(range(int((s - at("00")).total_seconds() // 3600), int((e - at("00")).total_seconds() // 3600)))
    blocked = set().union(*(hours(b[0], b[1]) for b in block))
    got = {}
    for r in left.collect():
        part = hours(r.start_timestamp, r.end_timestamp)
        assert part and not part & got.get(r.id, set())
        got.setdefault(r.id, set()).update(part)
    assert got == {i: h for i, b in enumerate(base) if (h := hours(b[0], b[1]) - blocked)}


def log_of(spark, rows):
    return spark.createDataFrame([(0, i, at(c), e) for i, (c, e) in enumerate(rows)], LOG)


def test_phone(spark):
    on, off, hidden, shown = "SCREEN_INTERACTIVE", "SCREEN_NON_INTERACTIVE", "KEYGUARD_HIDDEN", "KEYGUARD_SHOWN"
    log = log_of(spark, [("09:00:00", on), ("09:00:01", hidden), ("09:30:00", off), ("09:30:01", shown), ("09:30:02", "DEVICE_STARTUP")])
    assert [(r.start_timestamp, r.end_timestamp) for r in phone.active_intervals(log).collect()] == [(at("09:00:01"), at("09:30:00"))]
    assert phone.anomalies(log).count() == 1
    assert [(r.ts, r.kind) for r in phone.boundaries(log).collect()] == [(at("09:00:01"), "interval_start"), (at("09:30:00"), "interval_end")]
    log = log_of(spark, [("09:00:00", on), ("09:00:05", hidden), ("09:02:00", "DEVICE_SHUTDOWN"), ("09:30:00", "DEVICE_STARTUP"), ("09:35:00", off)])
    assert [(r.start_timestamp, r.end_timestamp) for r in phone.active_intervals(log).collect()] == [(at("09:00:05"), at("09:02:00")), (at("09:30:00"), at("09:35:00"))]
    short = spark.createDataFrame([(0, 1, at("09:00:00"), at("09:00:19")), (0, 2, at("10:00:00"), at("10:00:20"))], "tenant_id long, seq long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz")
    assert [r.seq for r in phone.drop_short(short).collect()] == [2]
    log = log_of(spark, [("09:00", hidden), ("11:00", hidden), ("11:05", shown)])
    assert [(r.ts, r.kind) for r in phone.single_signal(log, "keyguard").orderBy("seq").collect()] == [(at("11:00"), "interval_start"), (at("11:05"), "interval_end")]
    assert phone.unknown_ranges(log, until=at("12:00")).count() == 1 and phone.unknown_ranges(log).count() == 0


def test_dedupe_and_repoint(spark):
    e = events_of(spark, [("embed", "P", "x", "09"), ("phone", "P", "x", "09"), ("pc", "P", None, "10")])
    assert sorted(r.id for r in merge.deduplicate(e).collect()) == [0, 2]
    points = spark.createDataFrame([(0, 1), (0, 2), (0, 9)], "tenant_id long, event_id long")
    assert sorted(r.event_id for r in merge.repoint(points, merge.canonical_ids(e), ["event_id"]).collect()) == [0, 2, 9]
    assert merge.new_events(e, e).count() == 0 and merge.deduplicate(merge.deduplicate(e)).count() == 2


def test_append_keeps_repeats(spark):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    assert sorted(str(r.v) for r in merge.append_new_rows(rows("a", None), rows("a", "a", "b", None, None)).collect()) == ["None", "a", "b"]


def goal(spark, operator, target2=None):
    day = date(2026, 8, 1)
    series = spark.createDataFrame([(0, 1, "recurring", "day", day, None, "active", 1)], "tenant_id long, series_id long, schedule string, period string, start_period date, end_period_exclusive date, status string, revision long")
    rows = [(0, 1, 1, day, "t", "activity_duration", "embed", "Work", "Focus", operator, 3600)]
    rows += [(0, 2, 1, date(2026, 8, 3), "t", "activity_duration", "embed", "Work", "Focus", operator, target2)] if target2 else []
    return series, spark.createDataFrame(rows, "tenant_id long, version_id long, series_id long, effective_from date, title string, rule_type string, source string, category string, activity string, operator string, target_seconds long")


def test_goals(spark):
    periods = goals.spine("2026-08-01", "2026-08-03", spark)
    c = chunks_of(spark, [(at("09"), at("10"), "Work", "Focus", "embed"), (at("09"), at("11"), "Work", "Focus", "phone")])
    s, v = goal(spark, "at_least", 7200)
    got = {r.period_start.day: (r.target_seconds, r.actual_seconds, r.status_text) for r in goals.evaluate(s, v, periods, c, at("12"))[0].collect()}
    assert got == {1: (3600, 3600, "met"), 2: (3600, 0, "scheduled"), 3: (7200, 0, "scheduled")}
    s, v = goal(spark, "at_most")
    status = lambda now: {r.period_start.day: r.status_text for r in goals.evaluate(s, v, periods, c.limit(0), now)[0].collect()}
    assert status(at("12"))[1] == "on_track" and status(at("12", 2))[1] == "met"
    unknown = goals.evaluate(s, v.withColumn("rule_type", F.lit("other")), periods, c, at("12"))
    assert unknown[0].count() == 0 and unknown[1].count() == 3


def test_day_picture_and_note(spark):
    c = chunks_of(spark, [(at("00"), at("08"), "Body", "Sleep", "embed"), (at("09"), at("11"), "Work", "Working", "embed"), (at("12"), at("12:30"), "Body", "Eating", "embed"), (at("09:30"), at("10"), "Screen", "Screen on", "phone")])
    p = days.day_picture(c, "sleep").first()
    assert (p.tracked_seconds, p.screen_seconds, p.sleep_seconds, p.top_activity) == (37800, 1800, 28800, "Working")
    assert {o.name: o.overlap_percent for o in p.overlaps}["Working"] == 25.0
    n = days.daily_note(c, sleep="Sleep").first()
    assert (n.tracked, n.screen, n.top, n.week) == ("10h 30m", "30 minutes", "Working", "2026-W31") and n.screen_lines == "Working: 25.0%"
    assert "Working - 2h | +100.0%" in n.activity_lines
    assert days.note_text(days.daily_note(c), {"top": F.upper}).first().value.count("\n") >= 6


def test_markers(spark):
    m = spark.createDataFrame([(0, 1, "not-a-day", '{"exercise": "yes"}', '["Alice", 123]', "n", "3", 1), (0, 2, "2026-08-01", '{"a": true, "b": false}', "[]", "n", None, 1), (0, 3, "2026-02-30", "{}", '["x"]', None, "good", 1), (0, 4, "2026-08-01", "{bad", "{}", "n", "1", 1)], "tenant_id long, id long, day string, habits_json string, people_json string, quick_note_markdown string, mood string, revision long")
    found = {}
    for r in validate.marker_checks(m).collect():
        found.setdefault(r.object_id, []).append(r.message)
    assert len(found[1]) == 3 and 2 not in found and len(found[4]) == 3
    assert {"day is not an ISO date", "note is missing", "mood is not a number"} <= set(found[3])
    assert sorted(days.month_habits(m.filter("id = 2")).first().habits.items()) == [("a", True), ("b", False)]


def test_ranges():
    assert filters.custom_range(date(2026, 8, 1), date(2026, 8, 3)) == (datetime(2026, 8, 1), datetime(2026, 8, 4))
    assert filters.previous_range(datetime(2026, 8, 1), datetime(2026, 8, 4)) == (datetime(2026, 7, 29), datetime(2026, 8, 1))
    assert all(filters.preset_range(p, date(2026, 8, 1)) for p in filters.PRESETS)
    assert filters.previous_range(*filters.preset_range("All time", date(2026, 8, 1))) == (None, None)
    with pytest.raises(ValueError):
        filters.previous_range(datetime(2026, 8, 2), datetime(2026, 8, 2))
    with pytest.raises(ValueError):
        TimelineQuery().weekday(7)


def test_month_grid(spark):
    g = [r.day for r in days.month_grid(spark, 2026, 8, "2026-08-01", "2026-08-02").orderBy("day").collect()]
    assert (g[0], g[-1], len(g)) == (date(2026, 7, 27), date(2026, 9, 6), 42)


def test_durations(spark):
    df = spark.createDataFrame([(93784.0,), (0.0,), (0.5,), (1.5,), (-61.0,), (None,), (float("nan"),), (float("inf"),)], "s double")
    assert [r[0] for r in df.select(X.human_duration(F.col("s"))).collect()] == ["1d 2h 3m 4s", "0s", "0s", "2s", "-1m 1s", "—", "—", "—"]
    df = spark.createDataFrame([(5400,), (3660,), (30,), (-5,), (None,)], "s long")
    assert [r[0] for r in df.select(X.text_duration(F.col("s"))).collect()] == ["1 hour 30 minutes", "1 hour 1 minute", "0 minutes", "0 minutes", "0 minutes"]
    assert [r[0] for r in df.select(X.percent_change(F.col("s"), F.lit(3600))).collect()][:2] == ["+50.0%", "+1.7%"]
    assert spark.range(1).select(X.iso_week(F.lit(date(2027, 1, 1)))).first()[0] == "2026-W53"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,event,task\n2026-08-01T09:00:00+03:00,start,Work: Code: x\n2026-08-01 10:00:00,end,Walk\nbad,start,x\n2026-08-01 11:00:00,jump,x\n")
    good, bad = readers.read_embed_csv(spark, str(tmp_path / "a.csv"))
    assert [(r.timestamp, r.event_kind, r.category, r.name) for r in good.orderBy("timestamp").collect()] == [(at("09"), "interval_start", "Work", "Code: x"), (at("10"), "interval_end", None, "Walk")]
    assert sorted(r.reason for r in bad.collect()) == ["event", "timestamp"]
    with pytest.raises(Exception, match="bad row"):
        readers.read_embed_csv(spark, str(tmp_path / "a.csv"), strict=True)[0].collect()
    (tmp_path / "p.jsonl").write_text('{"seq": 1, "timestamp": "2026-08-01T09:00:00+03:00", "event": "SCREEN_INTERACTIVE"}\n\n{"seq": 2, "timestamp": "2026-08-01T09:00:00+03:00", "event": "OTHER"}\n')
    log = readers.read_phone_jsonl(spark, str(tmp_path / "p.jsonl"))
    assert [(r.seq, r.ts) for r in log.rows.collect()] == [(1, at("09"))] and [(r.event, r.ignored) for r in log.ignored.collect()] == [("OTHER", 1)]


def test_sinks(spark, tmp_path):
    c = chunks_of(spark, [(at("23:55"), at("08:00", 2), "Body", "Sleep", "embed"), (at("09", 2), at("10", 2), "a", "b", "pc")])
    first = readers.write_chunks(c, str(tmp_path / "chunks"))
    again = readers.write_chunks(readers.read_chunks(spark, first), str(tmp_path / "chunks"))
    assert again != first and sorted(readers.read_chunks(spark, again).select(c.columns).collect()) == sorted(c.collect())
    stored = readers.write_daily_notes(days.note_text(days.daily_note(c, sleep="Sleep")), str(tmp_path / "notes"))
    assert spark.read.parquet(stored).count() == 2 and stored != readers.write_daily_notes(spark.read.parquet(stored), str(tmp_path / "notes"))


def test_timeline_is_immutable_and_pushes_filters_down(spark, tmp_path):
    c = chunks_of(spark, [(at("09"), at("10"), "a", "x", "pc"), (at("09", 2), at("10", 2), "a", "y", "pc")])
    c.write.parquet(str(tmp_path / "c"))
    whole = Timeline(spark.read.parquet(str(tmp_path / "c")))
    one = whole.day("2026-08-01").source("pc")
    assert (whole.chunks().count(), one.chunks().count()) == (2, 1)
    plan = one.chunks().select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(start_time" in plan
    with pytest.raises(ValueError):
        TimelineQuery().duration(minimum=1).rows(c.drop("duration_seconds"), time_column="start_timestamp")
    assert one.by_activity().first().total_seconds == 3600 and stats.pivot(c, "name", "source", ["pc", "phone"]).filter("name = 'x'").first().phone == 0


def test_summary_counts_durations_first(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["pc", "phone", None]), rng.choice([None, 0, 1, 5, 5, 9, 400])) for _ in range(301)] + [("none", None), ("one", 7), ("two", 1), ("two", 2)]
    out = intervals.summary(spark.createDataFrame(rows, "source string, duration_seconds long"), ["source"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan  # no row holds a whole group
    want = {}
    for s in {r[0] for r in rows}:
        d = sorted(x for k, x in rows if k == s and x is not None)
        n = sum(k == s for k, _ in rows)
        want[s] = (n, sum(d) / 3600, d[0], d[len(d) // 2], d[-1]) if d else (n, None, None, None, None)
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == {s: (x[0], pytest.approx(x[1]), *x[2:]) for s, x in want.items()}
