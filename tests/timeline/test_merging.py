"""Redirects after changes that merge, and what an import reads."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import build, imports, merge

EVENTS = "tenant_id long, id long, timestamp timestamp_ntz, device_source string, event_kind string, category string, name string, revision long"
T0 = datetime(2026, 1, 1)


def events(rng, n, first=0):
    return [(rng.randrange(2), first + i, T0 + timedelta(hours=rng.randrange(6)), "pc", rng.choice(["interval_start", "interval_end"]), None, rng.choice("abcd"), 1) for i in range(n)]


def test_redirects_leave_nothing_dangling(spark):
    rng = random.Random(3)
    now = spark.createDataFrame(events(rng, 120), EVENTS).cache()
    points = now.select("tenant_id", F.col("id").alias("point"), F.col("id").alias("start_event_id"), F.col("id").alias("end_event_id")).cache()
    every, deleted = None, set()
    for k in range(3):  # each set renames some events, so that equal ones merge, and deletes some
        edits = now.filter((F.col("id") + k) % 3 == 0).withColumns({"op": F.lit("upsert"), "expected_revision": F.col("revision"), "name": F.lit("abc"[k])})
        gone = now.filter((F.col("id") + k) % 3 == 1).filter("id % 10 = 0").withColumns({"op": F.lit("delete"), "expected_revision": F.col("revision")})
        changes = edits.unionByName(gone)
        step = merge.redirects(now, changes)
        deleted |= {r.id for r in merge.gone_ids(now, changes).collect()}
        every = step if every is None else merge.then(every, step)
        now = spark.createDataFrame(merge.apply_changes(now, changes)[0].collect(), EVENTS).cache()
        every = spark.createDataFrame(every.collect(), every.schema)
    left = {(r.tenant_id, r.id) for r in now.collect()}
    moved = {(r.tenant_id, r.id): r.canonical_id for r in every.collect()}
    assert moved and not any((t, i) in left for t, i in moved)
    for row in merge.repoint(points, every, ["start_event_id", "end_event_id"]).collect():
        assert row.start_event_id == row.end_event_id == moved.get((row.tenant_id, row.point), row.point)
        assert (row.tenant_id, row.start_event_id) in left or row.start_event_id in deleted


def test_import_reads_each_table_once_for_its_keys(spark):
    rng = random.Random(9)
    stored, incoming = events(rng, 80), events(rng, 60, 500)
    made = imports.import_events(spark.createDataFrame(stored, EVENTS), spark.createDataFrame(incoming, EVENTS))
    key = lambda r: (r[0], r[2], r[4], r[5] or "", r[6])
    known = {key(r) for r in stored}
    new = {}
    for r in sorted(incoming, key=lambda r: r[1]):
        if key(r) not in known:
            new.setdefault(key(r), r)
    assert sorted(r.id for r in made.events.collect()) == sorted([r[1] for r in stored] + [r[1] for r in new.values()])
    after = spark.createDataFrame([*stored, *new.values()], EVENTS)
    built = build.build(after)
    assert made.chunks().count() == build.chunks_of(built).count() and made.warnings().count() == build.warnings_of(built).count()
    for r in made.summary.collect():
        own = [x for x in incoming if x[0] == r.tenant_id]
        assert (r.total, r.new, r.duplicates) == (len(own), sum(x[0] == r.tenant_id for x in new.values()), len(own) - sum(x[0] == r.tenant_id for x in new.values()))
        assert (r.first_timestamp, r.last_timestamp) == (min(x[2] for x in own), max(x[2] for x in own))
        assert r.chunks + r.warnings == built.filter(F.col("tenant_id") == r.tenant_id).count()
    plan = made.summary._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Relation") <= 2  # the judged keys and what was built
    made.close()
