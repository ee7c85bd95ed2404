"""Imports into a store against builds of all events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import build, incremental, merge

SCHEMA = "tenant_id long, id long, timestamp timestamp_ntz, device_source string, event_kind string, category string, name string, revision long"


def made(n, days, tenants=3, seed=1):
    rng = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    kinds = ["interval_start", "interval_end", "interval_end", "point"]
    return [(rng.randrange(tenants), i, t0 + timedelta(minutes=rng.randrange(days * 1440)), rng.choice(["pc", None]), rng.choice(kinds), rng.choice(["c", None]), rng.choice("ab"), 1) for i in range(n)]


def rows_of(built):
    return sorted(str(tuple(r)) for r in built.select([c.split()[0] for c in build.OUT.split(", ")]).collect())


def test_imports_equal_one_build(spark, tmp_path):
    rows = made(900, 40)
    store = incremental.Store(spark, str(tmp_path / "store")).create()
    assert store.version() == 0 and store.built().count() == 0
    rng = random.Random(4)
    parts = [[], [], []]
    for r in rows:
        parts[0 if rng.random() < 0.9 else rng.choice([1, 2])].append(r)
    for k, part in enumerate(parts):
        again = [(*r[:1], r[1] + 100_000, *r[2:]) for r in rng.sample(parts[0], 5)]  # repeats under other ids
        store.add(spark.createDataFrame(part + (again if k else []), SCHEMA))
    assert store.version() == 3 and incremental.Store(spark, str(tmp_path / "store")).create().version() == 3
    want = merge.deduplicate(spark.createDataFrame(parts[0], SCHEMA))
    for part in parts[1:]:
        want = want.unionByName(merge.new_events(spark.createDataFrame(part, SCHEMA), want).select(want.columns))
    assert rows_of(store.built()) == rows_of(build.build(want))
    assert store.events().count() == want.count()


def test_only_changed_days_are_built(spark, tmp_path):
    rows = made(3000, 60, tenants=2)
    store = incremental.Store(spark, str(tmp_path / "store")).create()
    day = datetime(2026, 1, 31).date()
    store.add(spark.createDataFrame([r for r in rows if r[2].date() != day], SCHEMA))
    anew = store.add(spark.createDataFrame([r for r in rows if r[2].date() == day], SCHEMA))
    days = {r.day for r in anew.collect()}
    assert day in days and min(days) == day and len(days) <= 6  # until the states are as before
    assert rows_of(store.built()) == rows_of(build.build(merge.deduplicate(spark.createDataFrame(rows, SCHEMA))))
    keys = spark.createDataFrame([(0, "pc", day)], "tenant_id long, source string, day date")
    plan = store._rows(keys, 2)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert "day" in scan.split("PartitionFilters")[1] and "2026-01-31" in scan
    # nothing new: nothing is built
    assert store.add(spark.createDataFrame(rows[:50], SCHEMA)).count() == 0


def test_failed_import_changes_nothing(spark, tmp_path, monkeypatch):
    rows = made(300, 10)
    store = incremental.Store(spark, str(tmp_path / "store")).create()
    store.add(spark.createDataFrame(rows[:200], SCHEMA))
    before = rows_of(store.built())
    monkeypatch.setattr(build, "results", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.add(spark.createDataFrame(rows[200:], SCHEMA))
    monkeypatch.undo()
    assert store.version() == 1 and rows_of(store.built()) == before and store.events().count() <= 200
    store.add(spark.createDataFrame(rows[200:], SCHEMA))
    assert rows_of(store.built()) == rows_of(build.build(merge.deduplicate(spark.createDataFrame(rows, SCHEMA)))) and store.events().filter(F.col("id") >= 200).count() > 0
