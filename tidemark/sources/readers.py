"""Files in and out: tracker CSV, phone JSON lines, canonical tables, chunk and note sinks."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_timestamp, split_task
from ..operators.filters import TimelineQuery
from .adapter import PHONE_EVENTS
from .lines import numbered_lines, strictly

CSV_SCHEMA = "timestamp string, event string, task string"
PHONE_SCHEMA = "timestamp string, event string, _corrupt string"
KINDS = {"start": "interval_start", "end": "interval_end", "point": "point"}


@dataclass(frozen=True)
class PhoneLog:
    """Log rows (tenant_id, seq, ts, event and where they come from), counts of events that are no signals, rejected lines."""

    rows: DataFrame
    ignored: DataFrame
    rejected: DataFrame


def tracker_events(raw: DataFrame, tenant_id: Column, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events, rejected rows) of raw tracker rows; offsets are dropped from timestamps."""
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    category, name = split_task(F.col("task"))
    rows = raw.select("*", tenant_id.alias("tenant_id"), parse_timestamp(F.col("timestamp")).alias("_ts"), kinds[F.lower(F.trim("event"))].alias("event_kind"), category.alias("category"), name.alias("name"))
    reason = F.when(F.col("_ts").isNull(), "timestamp").when(F.col("event_kind").isNull(), "event").when(F.coalesce("name", F.lit("")) == "", "task")
    judged = rows.withColumn("reason", reason)
    good = judged.filter("reason is null").select("tenant_id", F.col("_ts").alias("timestamp"), F.lit("embed").alias("device_source"), "event_kind", "category", "name", *keep)
    return good, judged.filter("reason is not null").select(*raw.columns, "reason")


def tracker_lines(lines: DataFrame, tenant_id: Column) -> tuple[DataFrame, DataFrame]:
    """(events, rejected rows) of numbered lines of tracker CSV: the first line of a file is its header, blank lines are
    skipped. Both carry file, line and seq, rejected rows also the line itself and the reason."""
    rows = lines.filter((F.col("line") > 1) & (F.trim("value") != "")).withColumn("_row", F.from_csv("value", CSV_SCHEMA))
    return tracker_events(rows.select(*lines.columns, "_row.*"), tenant_id, ("file", "line", "seq"))


def read_embed_csv(spark: SparkSession, path: str, *, tenant_id: int | Column = 0, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tracker CSV with a header, of rows without line breaks inside quotes. Bad rows are returned beside the events with their
    file and line; strict raises on them when read. tenant_id: a number, or a column of the partition folders."""
    events, rejected = tracker_lines(numbered_lines(spark, path), _tenant(tenant_id))
    return (strictly(events, rejected) if strict else events), rejected


def read_phone_jsonl(spark: SparkSession, path: str, *, tenant_id: int | Column = 0, strict: bool = False) -> PhoneLog:
    """A phone's JSON lines. Blank lines are skipped; rows of equal time are in the order of their lines (seq)."""
    log = phone_lines(numbered_lines(spark, path), _tenant(tenant_id))
    return PhoneLog(strictly(log.rows, log.rejected), log.ignored, log.rejected) if strict else log


def _tenant(tenant_id: int | Column) -> Column:
    return (F.lit(tenant_id) if isinstance(tenant_id, int) else tenant_id).cast("long")


def phone_lines(lines: DataFrame, tenant_id: Column) -> PhoneLog:
    """The log of numbered lines. A line is rejected that is no JSON object, has no event, or a signal without a time."""
    row = F.from_json("value", PHONE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.filter(F.trim("value") != "").withColumn("_row", row).select(*lines.columns, "_row.*")
    rows = parsed.select(*lines.columns, tenant_id.alias("tenant_id"), parse_timestamp(F.col("timestamp")).alias("ts"), "event", "_corrupt")
    reason = F.when(F.col("_corrupt").isNotNull(), "json").when(F.col("event").isNull(), "event").when(F.col("event").isin(*PHONE_EVENTS) & F.col("ts").isNull(), "timestamp")
    judged = rows.withColumn("reason", reason).drop("_corrupt")
    good = judged.filter("reason is null")
    known = F.col("event").isin(*PHONE_EVENTS)
    ignored = good.filter(~known).groupBy("tenant_id", "event").agg(F.count("*").alias("ignored"))
    return PhoneLog(good.filter(known).select("tenant_id", "seq", "ts", "event", "file", "line"), ignored, judged.filter("reason is not null").drop("ts", "event"))


def phone_rows(raw: DataFrame, tenant_id: Column) -> tuple[DataFrame, DataFrame]:
    """(log rows, counts of other events) of a table that has its own seq."""
    rows = raw.select(tenant_id.alias("tenant_id"), "seq", parse_timestamp(F.col("timestamp")).alias("ts"), "event")
    known = F.col("event").isin(*PHONE_EVENTS) & F.col("ts").isNotNull()
    return rows.filter(known), rows.filter(~F.coalesce(known, F.lit(False))).groupBy("tenant_id", "event").agg(F.count("*").alias("ignored"))


def scan_table(spark: SparkSession, path: str, query: TimelineQuery = TimelineQuery(), **columns: str) -> DataFrame:
    """A Parquet table under a query; the conditions reach the scan."""
    return query.rows(spark.read.parquet(path), **columns)


def scan_day_markers(markers: DataFrame, first: str, last: str) -> DataFrame:
    """Both days are part of the range."""
    return markers.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def scan_goals(series: DataFrame, versions: DataFrame) -> DataFrame:
    """Series with their versions as a sorted list."""
    v = versions.groupBy("tenant_id", "series_id").agg(F.array_sort(F.collect_list(F.struct("effective_from", "version_id", "title", "target_seconds"))).alias("versions"))
    return series.join(v, ["tenant_id", "series_id"], "left")


def write_chunks(chunks: DataFrame, path: str) -> str:
    """Full replacement: a new folder under path, partitioned by start date; readers switch to it when it is whole.
    Returns the folder. Nothing that may be read just now is overwritten."""
    target = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    dated = chunks.withColumn("start_date", F.to_date("start_timestamp"))
    # rebalancing splits a large day over tasks and files
    dated.hint("rebalance", "start_date").sortWithinPartitions("tenant_id", "source", "start_timestamp").write.partitionBy("start_date").parquet(target)
    return target


def read_chunks(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("start_date")


def write_daily_notes(notes: DataFrame, path: str) -> str:
    """A new folder under path with one Parquet row (tenant_id, value) a tenant and day, in folders by day; returns the
    folder. A day is a few files, however many tenants it has, and nothing that may be read is overwritten."""
    target = f"{path.rstrip('/')}/version={uuid.uuid4().hex}"
    notes.select("day", "tenant_id", "value").hint("rebalance", "day").sortWithinPartitions("day", "tenant_id").write.partitionBy("day").parquet(target)
    return target
