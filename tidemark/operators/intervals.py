"""Interval algebra on chunks: clip, split at calendar boundaries, overlap joins, intersection and subtraction."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sweep import overlapping

PERIODS = ("hour", "day", "week", "month", "year")


def seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def period_start(ts: Column, period: str) -> Column:
    if period not in PERIODS:
        raise ValueError(f"period is one of {PERIODS}")
    return F.date_trunc(period, ts).cast("timestamp_ntz")


def next_period(start: Column, period: str) -> Column:
    unit = {"week": F.lit(7)}.get(period, F.lit(1))
    return F.timestamp_add({"hour": "HOUR", "day": "DAY", "week": "DAY", "month": "MONTH", "year": "YEAR"}[period], unit, start)


def clip(chunks: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Chunks that overlap [start, end), cut to it, with new durations; chunks that end before they start go."""
    s, e = F.col("start_timestamp"), F.col("end_timestamp")
    if start:
        bound = F.lit(start).cast("timestamp_ntz")
        chunks = chunks.filter(e > bound).withColumn("start_timestamp", F.greatest(s, bound))
    if end:
        bound = F.lit(end).cast("timestamp_ntz")
        chunks = chunks.filter(s < bound).withColumn("end_timestamp", F.least(e, bound))
    return chunks.withColumn("duration_seconds", seconds(s, e)).filter("duration_seconds >= 0")


def split(chunks: DataFrame, period: str) -> DataFrame:
    """One row for each calendar period that a chunk touches, with the period's start. Zero-length chunks vanish."""
    s, e = F.col("start_timestamp"), F.col("end_timestamp")
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[period]
    last = period_start(F.timestamp_add("MICROSECOND", F.lit(-1), e), period)
    cut = chunks.filter(s < e).withColumn("period", F.explode(F.sequence(period_start(s, period), last, F.expr(step))))
    cut = cut.withColumn("start_timestamp", F.greatest(s, F.col("period"))).withColumn("end_timestamp", F.least(e, next_period(F.col("period"), period)))
    return cut.withColumn("duration_seconds", seconds(s, e))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces shared by a left and a right interval of the same keys: left_id, right_id, start_timestamp, end_timestamp.
    Both need id, start_timestamp and end_timestamp."""
    return overlapping(left, right, keys)


def intersect(activities: DataFrame, screens: DataFrame, *, keys: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Per keys, category and name: activity seconds, seconds inside screens, the rest, all screen seconds, percent."""
    by = [*keys, "category", "name"]
    pairs = overlap_pairs(activities, screens, list(keys)).groupBy(*keys, F.col("left_id").alias("id")).agg(F.sum(seconds(F.col("start_timestamp"), F.col("end_timestamp"))).alias("inside"))
    spent = activities.withColumn("spent", seconds(F.col("start_timestamp"), F.col("end_timestamp")))
    totals = spent.join(pairs, [*keys, "id"], "left").groupBy(*by).agg(F.sum("spent").alias("activity_seconds"), F.coalesce(F.sum("inside"), F.lit(0)).alias("overlap_seconds"))
    screen = screens.groupBy(*keys).agg(F.sum(seconds(F.col("start_timestamp"), F.col("end_timestamp"))).alias("screen_seconds"))
    out = totals.join(screen, list(keys), "left").withColumn("screen_seconds", F.coalesce("screen_seconds", F.lit(0)))
    percent = F.when(F.col("activity_seconds") > 0, F.col("overlap_seconds") * 100.0 / F.col("activity_seconds")).otherwise(0.0)
    return out.select(*by, "activity_seconds", "overlap_seconds", (F.col("activity_seconds") - F.col("overlap_seconds")).alias("remainder_seconds"), "screen_seconds", percent.alias("overlap_percent"))


def intersect_over_time(activities: DataFrame, screens: DataFrame, period: str) -> DataFrame:
    """intersect inside each calendar period; periods without activity are left out."""
    return intersect(split(activities, period), split(screens, period), keys=("tenant_id", "period"))


def scoped(chunks: DataFrame, query, names: list[str]) -> DataFrame:
    """Activities for an intersection: of a query only its time range and weekday count; blank names are dropped and no
    name at all gives no rows."""
    from .filters import TimelineQuery

    wanted = [n for n in names if n and n.strip()]
    bare = TimelineQuery(start=query.start, end=query.end, weekday_is=query.weekday_is)
    out = bare.clipped(chunks)
    return out.filter(F.col("name").isin(*wanted)) if wanted else out.filter(F.lit(False))


def subtract(base: DataFrame, blockers: DataFrame) -> DataFrame:
    """base without blockers: the pieces that are left (tenant_id, id, start_timestamp, end_timestamp)."""
    holes = overlap_pairs(base, blockers, ["tenant_id"]).select("tenant_id", F.col("left_id").alias("id"), F.col("start_timestamp").alias("from"), F.col("end_timestamp").alias("to"))
    own = base.filter("start_timestamp < end_timestamp").select("tenant_id", "id", "start_timestamp", "end_timestamp")
    # the interval's end is one more hole, of no length
    edges = own.join(holes, ["tenant_id", "id"]).unionByName(own.withColumn("from", F.col("end_timestamp")).withColumn("to", F.col("end_timestamp")))
    before = Window.partitionBy("tenant_id", "id").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.max("to").over(before), F.col("start_timestamp"))
    return edges.withColumn("piece", start).filter("piece < `from`").select("tenant_id", "id", F.col("piece").alias("start_timestamp"), F.col("from").alias("end_timestamp"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Intervals that only one side has, with the side's name."""
    cols = ["tenant_id", "start_timestamp", "end_timestamp"]
    a, b = left.select(cols), right.select(cols)
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def summary(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Count, hours, shortest, upper median and longest."""
    d, n = F.col("duration_seconds"), F.col("n")
    rows = chunks.groupBy(*by, "duration_seconds").agg(F.count("*").alias("n"))
    # only distinct durations meet in a window
    known = F.when(d.isNotNull(), n).otherwise(0)
    group = Window.partitionBy(*by)
    upto = F.sum(known).over(group.orderBy("duration_seconds").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"upto": upto, "half": F.floor(F.sum(known).over(group) / 2)})
    median = F.min(F.when(F.col("upto") > F.col("half"), d))
    return rows.groupBy(*by).agg(F.sum("n").alias("intervals"), (F.sum(d * n) / 3600.0).alias("hours"), F.min(d).alias("shortest"), median.alias("upper_median"), F.max(d).alias("longest"))


def longest(chunks: DataFrame, n: int) -> DataFrame:
    """The n longest chunks of each tenant."""
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy(F.desc("duration_seconds"), "start_timestamp", "id"))
    return chunks.withColumn("rank", rank).filter(F.col("rank") <= n)
