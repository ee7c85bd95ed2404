"""Effective-dated duration goals over day and ISO-week periods.

goal_series: tenant_id, series_id, schedule (recurring, one_off), period (day, week), start_period, end_period_exclusive, status,
revision. goal_versions: tenant_id, version_id, series_id, effective_from, title, rule_type, source, category, activity, operator,
target_seconds.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import split

_S = ["tenant_id", "series_id"]


def period_of(day: Column, period: Column) -> Column:
    """First day of the day's or ISO week's period."""
    return F.when(period == "week", F.date_trunc("week", day).cast("date")).otherwise(day)


def next_of(start: Column, period: Column) -> Column:
    return F.date_add(start, F.when(period == "week", 7).otherwise(1))


def spine(first: str, last: str, spark) -> DataFrame:
    """Every day and ISO-week period that touches [first, last]."""
    days = spark.sql("SELECT 1 AS one").select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("d"))
    kinds = days.select(F.explode(F.array(F.lit("day"), F.lit("week"))).alias("period"), "d")
    return kinds.select("period", period_of(F.col("d"), F.col("period")).alias("period_start")).distinct()


def goals_in_periods(series: DataFrame, periods: DataFrame) -> DataFrame:
    """Series that hold in each period; an archived one counts until its end."""
    holds = (F.col("start_period") <= F.col("period_start")) & (F.col("end_period_exclusive").isNull() | (F.col("period_start") < F.col("end_period_exclusive")))
    return series.join(periods, "period").filter(holds)


def as_of(goals: DataFrame, versions: DataFrame) -> DataFrame:
    """Each goal and period with the version that is in force: the latest effective_from, then the largest id."""
    v = versions.withColumn("until", F.lead("effective_from").over(Window.partitionBy(*_S).orderBy("effective_from", "version_id")))
    in_force = (F.col("effective_from") <= F.col("period_start")) & (F.col("until").isNull() | (F.col("period_start") < F.col("until")))
    return goals.join(v, _S).filter(in_force).drop("until")


def activity_duration(goals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Seconds with exactly the rule's source, category and activity in each goal's period."""
    totals = None
    for period in ("day", "week"):
        t = split(chunks, period).groupBy("tenant_id", "source", "category", F.col("name").alias("activity"), F.lit(period).alias("period"), F.to_date("period").alias("period_start")).agg(F.sum("duration_seconds").alias("actual_seconds"))
        totals = t if totals is None else totals.unionByName(t)
    return goals.join(totals, ["tenant_id", "source", "category", "activity", "period", "period_start"], "left").withColumn("actual_seconds", F.coalesce("actual_seconds", F.lit(0)))


#: How each type of rule is measured; further types can be added.
EVALUATORS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"activity_duration": activity_duration}


def status(now: datetime) -> Column:
    today, end = F.lit(now).cast("timestamp_ntz"), next_of(F.col("period_start"), F.col("period")).cast("timestamp_ntz")
    start = F.col("period_start").cast("timestamp_ntz")
    reached, over = F.col("actual_seconds") >= F.col("target_seconds"), F.col("actual_seconds") > F.col("target_seconds")
    running = today < end
    at_least = F.when(reached, "met").when(running, "in_progress").otherwise("missed")
    at_most = F.when(over, "missed").when(running, "on_track").otherwise("met")
    return F.when(today < start, "scheduled").when(F.col("operator") == "at_least", at_least).otherwise(at_most)


def evaluate(series: DataFrame, versions: DataFrame, periods: DataFrame, chunks: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(progress of every goal in every period, goals whose rule type has no evaluator)."""
    goals = as_of(goals_in_periods(series, periods), versions)
    known = list(EVALUATORS)
    out = None
    for kind in known:
        part = EVALUATORS[kind](goals.filter(F.col("rule_type") == kind), chunks)
        out = part if out is None else out.unionByName(part)
    ratio = F.when(F.col("target_seconds") > 0, F.col("actual_seconds") / F.col("target_seconds"))
    return out.withColumn("status_text", status(now)).withColumn("ratio", ratio), goals.filter(~F.col("rule_type").isin(*known))


def normalise(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with bounds aligned to their period, rejected ones with a reason)."""
    period = F.col("period")
    start = period_of(F.col("start_day"), period)
    end = F.when(F.col("schedule") == "one_off", next_of(start, period)).otherwise(period_of(F.col("end_day"), period))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(blank("category"), "category is blank").when(blank("activity"), "activity is blank").when(blank("title"), "title is blank").when(F.coalesce("target_seconds", F.lit(0)) <= 0, "target is not positive").when(F.col("end_period_exclusive") < F.col("start_period"), "end before start")
    rows = requests.withColumn("start_period", start).withColumn("end_period_exclusive", end).withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason", "start_day", "end_day"), rows.filter("reason is not null")


def revise(series: DataFrame, versions: DataFrame, changes: DataFrame, today: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series with the next revision where a change was taken, versions after the changes, rejected changes). changes:
    versions with expected_revision."""
    c = changes.join(series.select(*_S, "schedule", "period", "start_period", "end_period_exclusive", "status", "revision"), _S, "left")
    current = period_of(today, F.col("period"))
    reason = (
        F.when(F.col("status").isNull(), "unknown series")
        .when(F.col("status") == "archived", "archived")
        .when(F.col("revision") != F.col("expected_revision"), "stale revision")
        .when((F.col("schedule") == "one_off") & (F.col("end_period_exclusive") <= current), "completed")
        .when(F.col("effective_from") < current, "before the current period")
        .when(F.col("effective_from") < F.col("start_period"), "before the start")
        .when(F.col("effective_from") >= F.col("end_period_exclusive"), "at or after the end")
    )
    judged = c.withColumn("reason", reason)
    good = judged.filter("reason is null").select(versions.columns)
    kept = versions.join(good.select(*_S, "effective_from"), [*_S, "effective_from"], "left_anti").select(versions.columns)
    hit = good.select(*_S).distinct().withColumn("_hit", F.lit(1))
    revised = series.join(hit, _S, "left").withColumn("revision", F.col("revision") + F.coalesce("_hit", F.lit(0))).select(series.columns)
    return revised, kept.unionByName(good), judged.filter("reason is not null").select(*changes.columns, "reason")


def archive(series: DataFrame, chosen: DataFrame, today: Column) -> DataFrame:
    """Chosen series end with their current period, or at once if they have not begun; an earlier end stays."""
    current = period_of(today, F.col("period"))
    end = F.when(F.col("start_period") > current, F.col("start_period")).otherwise(next_of(current, F.col("period")))
    hit = F.col("_hit").isNotNull() & (F.col("status") != "archived")
    marked = series.join(chosen.select(*_S).distinct().withColumn("_hit", F.lit(1)), _S, "left")
    return marked.withColumn("end_period_exclusive", F.when(hit, F.least("end_period_exclusive", end)).otherwise(F.col("end_period_exclusive"))).withColumn("revision", F.when(hit, F.col("revision") + 1).otherwise(F.col("revision"))).withColumn("status", F.when(hit, "archived").otherwise(F.col("status"))).drop("_hit").select(series.columns)


def duplicate_one_off(series: DataFrame, versions: DataFrame, day: Column) -> DataFrame:
    """New one-off goals for the chosen day's period from each one-off series' latest version, as normalised requests."""
    rule = [c for c in versions.columns if c not in (*_S, "version_id", "effective_from")]
    latest = versions.groupBy(*_S).agg(F.max_by(F.struct(*rule), F.struct("effective_from", "version_id")).alias("rule"))
    rows = series.filter("schedule = 'one_off'").join(latest, _S).withColumn("start_period", period_of(day, F.col("period")))
    return rows.select("tenant_id", F.col("series_id").alias("copied_from"), "schedule", "period", "start_period", next_of(F.col("start_period"), F.col("period")).alias("end_period_exclusive"), "rule.*")
