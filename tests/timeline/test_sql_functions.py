"""SQL functions beside the column functions on odd values; plans have no Python."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sql
from tidemark.functions import text as X
from tidemark.operators import intervals


@pytest.fixture
def registered(spark):
    sql.register(spark)
    sql.register(spark)
    return spark


def column(df, expression):
    return [r[0] for r in df.orderBy("k").select(expression).collect()]


def test_durations(registered):
    values = [93784.0, 0.0, 0.5, 1.5, 2.5, -61.0, -0.2, 59.6, 3600.0, 864000.0, None, float("nan"), float("inf")]
    df = registered.createDataFrame(list(enumerate(values)), "k int, s double")
    assert column(df, F.expr("human_duration(s)")) == column(df, X.human_duration(F.col("s")))
    df = registered.createDataFrame(list(enumerate([5400, 3660, 3600, 7200, 60, 59, 30, 0, -5, None])), "k int, s long")
    assert column(df, F.expr("text_duration(s)")) == column(df, X.text_duration(F.col("s")))
    assert column(df, F.expr("clock_duration(s)")) == column(df, X.clock_duration(F.col("s")))
    assert column(df, F.expr("clock_duration(s, true)")) == column(df, X.clock_duration(F.col("s"), with_seconds=True))


def test_texts(registered):
    texts = [None, "", " ", "a", "a: b", ": b", "a :", "a: b: c", " 3.5 ", "x,y\n x ,, z", "2026-08-01T09:00:00+03:00", "2026-02-30"]
    df = registered.createDataFrame([(k, t, texts[k - 1]) for k, t in enumerate(texts)], "k int, t string, u string")
    assert column(df, F.expr("parse_people(t)")) == column(df, X.parse_people(F.col("t")))
    assert column(df, F.expr("parse_mood(t)")) == column(df, X.parse_mood(F.col("t")))
    assert column(df, F.expr("parse_event_time(t)")) == column(df, X.parse_timestamp(F.col("t")))
    category, name = X.split_task(F.col("t"))
    assert column(df.filter("t IS NOT NULL"), F.expr("split_task(t).category")) == column(df.filter("t IS NOT NULL"), category)
    assert column(df, F.expr("split_task(t).name")) == column(df, name)
    assert column(df, F.expr("activity_label(t, u)")) == column(df, X.activity_label(F.col("t"), F.col("u")))
    assert column(df, F.expr("activity_label(t, u, ' / ', false)")) == column(df, X.activity_label(F.col("t"), F.col("u"), separator=" / ", name_first=False))
    df = registered.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 0.0), (2, 5.0, 4.0), (3, None, 4.0)], "k int, a double, b double")
    assert column(df, F.expr("percent_change(a, b)")) == column(df, X.percent_change(F.col("a"), F.col("b")))


def test_periods_and_plans(registered):
    df = registered.sql("SELECT 0 AS k, timestamp_ntz'2023-12-31 22:30:00' AS start_timestamp, timestamp_ntz'2024-03-01 00:00:00' AS end_timestamp UNION ALL SELECT 1, timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 00:00:00'")
    for period in intervals.PERIODS:
        assert column(df, F.expr(f"period_label(start_timestamp, '{period}')")) == column(df, X.period_label(F.col("start_timestamp"), period))
        want = intervals.split(df, period).select("k", "period", "start_timestamp", "end_timestamp", "duration_seconds")
        got = registered.sql("SELECT d.k, p.* FROM {d} d, LATERAL split_interval(d.start_timestamp, d.end_timestamp, '" + period + "') p", d=df)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Generate explode" in plan and "Join" not in plan
