"""Overlapping pairs against plain loops, and on dense days."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, sweep

SCHEMA = "tenant_id long, id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz"
T0 = datetime(2026, 3, 1)


def made(n, seed, days=4, longest=3 * 1440):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        start = T0 + timedelta(minutes=rng.randrange(days * 1440) // 30 * 30)
        rows.append((rng.choice([1, 1, 2, None]), k, start, start + timedelta(minutes=rng.choice([0, 30, 60, 1440, rng.randrange(longest)]))))
    return rows


@pytest.mark.parametrize("rows", [sweep.ROWS, 7])
def test_against_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(sweep, "PAIRS", 5)
    left, right = made(120, 1), [(t, k + 1000, s, e) for t, k, s, e in made(150, 2)]
    got = intervals.overlap_pairs(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["tenant_id"])
    assert got.columns == ["tenant_id", "left_id", "right_id", "start_timestamp", "end_timestamp"]
    want = [(a[0], a[1], b[1], max(a[2], b[2]), min(a[3], b[3])) for a in left for b in right if a[0] is not None and a[0] == b[0] and a[2] < a[3] and b[2] < b[3] and max(a[2], b[2]) < min(a[3], b[3])]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 500


def test_same_side_and_text_ids(spark):
    rows = spark.createDataFrame([(1, "a", T0, T0 + timedelta(hours=1)), (1, "b", T0, T0 + timedelta(hours=2))], "tenant_id long, id string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz")
    got = intervals.overlap_pairs(rows, rows, ["tenant_id"])
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    assert intervals.overlap_pairs(rows.limit(0), rows, ["tenant_id"]).count() == 0


def test_dense_day(spark):
    """100,000 intervals of half a second in a day of one tenant on either side: all pairs of the day would be 10 billion."""
    side = lambda shift: spark.range(100_000).select(F.lit(1).cast("long").alias("tenant_id"), "id", (F.timestamp_micros(F.col("id") * 864_000 + shift)).cast("timestamp_ntz").alias("start_timestamp"), (F.timestamp_micros(F.col("id") * 864_000 + shift + 500_000)).cast("timestamp_ntz").alias("end_timestamp"))
    begun = time.time()
    got = intervals.overlap_pairs(side(0), side(100_000), ["tenant_id"]).select("left_id", "right_id").agg(F.count("*"), F.sum(F.when(F.col("left_id") == F.col("right_id"), 1))).first()
    assert tuple(got) == (100_000, 100_000) and time.time() - begun < 60
