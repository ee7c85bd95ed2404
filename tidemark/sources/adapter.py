"""Canonical timeline tables from a click-stream table (event_id, ts, user_id, event_type, value, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.carry import neighbour

#: Event names of a phone's log.
PHONE_EVENTS = ("SCREEN_INTERACTIVE", "SCREEN_NON_INTERACTIVE", "KEYGUARD_HIDDEN", "KEYGUARD_SHOWN", "DEVICE_SHUTDOWN", "DEVICE_STARTUP")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _typed(e: DataFrame) -> DataFrame:
    t = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    source = F.when(F.col("event_id") % 3 == 0, "embed").when(F.col("event_id") % 3 == 1, "pc").otherwise("phone")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
    return e.select(F.col("user_id").alias("tenant_id"), F.col("event_id").alias("id"), t.alias("t"), source.alias("source"), "event_type", "value", k.alias("k"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals: an event lasts `value` minutes, or until the tenant's next event of the same source."""
    e = neighbour(_base(spark, sf_dir), ["tenant_id", "source"], ["t", "id"], {"following": "t"}, ahead=True)
    end = F.least(F.timestamp_add("SECOND", F.floor(F.col("value") * 60).cast("int"), F.col("t")), "following")
    screen = (F.col("source") == "phone") & F.col("event_type").isin("click", "view")
    category = F.when(screen, "Screen").when(F.col("k") % 10 != 0, F.col("event_type"))
    name = F.when(screen, "Screen on").otherwise(F.concat(F.lit("A"), (F.col("k") % 4).cast("string")))
    out = e.select("tenant_id", "id", F.col("t").alias("start_timestamp"), end.alias("end_timestamp"), category.alias("category"), name.alias("name"), "source")
    return out.withColumn("duration_seconds", seconds_between(F.col("start_timestamp"), F.col("end_timestamp")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, end and point observations."""
    return events_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_of(clicks: DataFrame) -> DataFrame:
    """events of a click-stream table, which may be a stream."""
    kind = F.when(F.col("event_type").isin("click", "view"), "interval_start").when(F.col("event_type").isin("purchase", "signup"), "interval_end").otherwise("point")
    return _typed(clicks).select("tenant_id", "id", F.col("t").alias("timestamp"), F.col("source").alias("device_source"), kind.alias("event_kind"), F.lit("Work").alias("category"), F.concat(F.lit("A"), (F.col("k") % 3).cast("string")).alias("name"), F.lit(1).cast("long").alias("revision"))


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, and every fiftieth again under another id and source."""
    return repeated_of(events(spark, sf_dir))


def repeated_of(e: DataFrame) -> DataFrame:
    """repeated_events of events, which may be a stream."""
    again = e.filter("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("device_source", F.when(F.col("device_source") == "embed", "pc").otherwise("embed"))
    return e.unionByName(again)


def phone_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant_id, seq, ts, event: one device a tenant."""
    name: Column = F.element_at(F.array(*map(F.lit, PHONE_EVENTS)), (F.col("id") % 6 + 1).cast("int"))
    return _base(spark, sf_dir).select("tenant_id", F.col("id").alias("seq"), F.col("t").alias("ts"), name.alias("event"))


def day_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw marker row for each tenant and day with a purchase: JSON texts, some of them damaged."""
    e = _base(spark, sf_dir).filter("event_type = 'purchase'")
    g = e.groupBy("tenant_id", F.to_date("t").alias("d")).agg(F.min("id").alias("id"), F.min("k").alias("k"), F.max("value").alias("v"))
    habits = F.when(F.col("k") == 3, '{"walk": "yes"}').when(F.col("k") == 4, "not json").otherwise(F.concat(F.lit('{"walk": '), (F.col("k") % 2 == 0).cast("string"), F.lit(', "read": true}')))
    people = F.when(F.col("k") == 5, '["Ann", 1]').when(F.col("k") % 3 == 0, "[]").otherwise(F.concat(F.lit('["Ann", "B'), F.col("k").cast("string"), F.lit('"]')))
    day = F.when(F.col("id") % 97 == 0, "not-a-day").otherwise(F.date_format("d", "yyyy-MM-dd"))
    note = F.when(F.col("id") % 41 == 0, F.lit(None)).when(F.col("k") % 4 == 0, "  ").otherwise(F.concat(F.lit("note "), F.col("k").cast("string")))
    mood = F.when(F.col("id") % 53 == 0, "great").otherwise((F.col("k") % 5 + 1).cast("string"))
    return g.select("tenant_id", "id", day.alias("day"), habits.alias("habits_json"), people.alias("people_json"), note.alias("quick_note_markdown"), mood.alias("mood"), F.lit(1).cast("long").alias("revision"))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)
