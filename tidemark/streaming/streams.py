"""Structured Streaming forms of import, interval construction and period totals. Batch results stay the authority."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build
from ..operators.intervals import split
from ..operators.merge import EVENT_KEY, deduplicate, new_events
from ..sources.lines import number_lines, placed_lines
from ..sources.readers import tracker_lines
from ..sources.shared import shared_dir
from .stateful import interval_steps, period_steps, rocksdb

CHUNKS = "tenant_id long, source string, start_event_id long, end_event_id long, start_timestamp timestamp, end_timestamp timestamp, category string, name string"
EVENTS = "tenant_id long, id long, timestamp timestamp, device_source string, event_kind string, category string, name string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as a stream of its files, with the table's own schema."""
    # as a pattern, the path may name a file as well as a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def run_available(df: DataFrame, tag: str) -> DataFrame:
    """Run a stream over what is there now and read its output; state and output lie in the shared folder."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/streams/{tag}-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/rows")


def run_stateful(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """run_available with the state in RocksDB; also returns the folder of the stream's state."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/streams/{tag}-{uuid.uuid4().hex}"
    with rocksdb(spark):
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/rows"), f"{place}/state"


#: Bytes of the files of a micro-batch of the import.
BATCH_BYTES = 512 << 20
IMPORTED = "tenant_id long, timestamp timestamp_ntz, device_source string, event_kind string, category string, name string, file string, line long, id long, day date"


def import_tracker_files(spark: SparkSession, path: str, target: str, *, tenant_id: Column, folders: str = "", files_per_trigger: int | None = None) -> None:
    """Import the tracker CSV files under path that are new since the last call, under target: events (new ones only, each
    once), rejected (lines that can't be read, with file, line and reason), and the stream's state.

    A micro-batch writes folders of its own number and replaces them if it runs again after a failure, and it compares its
    events with those of earlier numbers on its own days only. So a restart neither repeats nor loses a row. A micro-batch takes
    BATCH_BYTES of files, or files_per_trigger of them if that is given: many small logs are few micro-batches. `folders` are
    the types of partition folders ("log long"), of which tenant_id may be made."""
    schema = "value string" + (f", {folders}" if folders else "")
    size = ("maxBytesPerTrigger", BATCH_BYTES) if files_per_trigger is None else ("maxFilesPerTrigger", files_per_trigger)
    lines = placed_lines(spark.readStream.format("text").schema(schema).option(*size).load(path))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        events, rejected = tracker_lines(number_lines(batch), tenant_id)
        _write_batch(events, rejected, target, number)
        batch.unpersist()

    lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()


def _write_batch(events: DataFrame, rejected: DataFrame, target: str, number: int) -> None:
    spark = events.sparkSession
    rejected.write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
    dated = events.withColumn("id", F.lit(number << 40) + F.col("seq")).withColumn("day", F.to_date("timestamp")).drop("seq")
    first, last = dated.agg(F.min("day"), F.max("day")).first()
    fresh = deduplicate(dated)
    if number and first is not None:
        known = imported_events(spark, target).filter((F.col("batch") < number) & F.col("day").between(first, last))
        fresh = new_events(dated, known)
    # files of a day follow its size
    fresh.select([x.split()[0] for x in IMPORTED.split(", ")]).hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{target}/events/batch={number}")


def imported_events(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(f"{IMPORTED}, batch long").parquet(f"{target}/events")


def rejected_lines(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{target}/rejected").drop("batch")


def stream_import(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Events once each, as far as repeats come within the delay."""
    keyed = events.withColumns({c: F.coalesce(c, F.lit("")) for c in ("category", "name")})
    return keyed.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(EVENT_KEY))


def stream_build_chunks(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Chunks, warnings and late events (stateful.STEPS) as the watermark passes the events. Run it with run_stateful."""
    return interval_steps(events, delay)


def with_tail(steps: DataFrame, events: DataFrame) -> DataFrame:
    """All chunks of the events: those of the stream that ended before the key's first late event, and what the batch build
    makes of the key's events after the last of them, when it was idle. That repairs what late events changed and adds what the
    watermark held back."""
    late = F.coalesce("start_timestamp", "end_timestamp")
    first_late = steps.filter("kind = 'late'").groupBy("tenant_id", "source").agg(F.min(late).alias("late"))
    same = lambda a, b: a["tenant_id"].eqNullSafe(b["_tenant"]) & a["source"].eqNullSafe(b["_source"])
    named = lambda df, *c: df.select(F.col("tenant_id").alias("_tenant"), F.col("source").alias("_source"), *c)
    chunks = steps.filter("kind = 'chunk'").drop("kind")
    bounds = named(first_late, "late")
    kept = chunks.join(bounds, same(chunks, bounds), "left").filter("late IS NULL OR end_timestamp < late").select(chunks.columns)
    last = named(kept.groupBy("tenant_id", "source").agg(F.max(F.struct("end_timestamp", "end_event_id")).alias("last")), "last")
    rows = events.withColumnRenamed("device_source", "source")
    time = F.struct(F.col("timestamp").cast("timestamp").alias("end_timestamp"), F.col("id").alias("end_event_id"))
    rest = rows.join(last, same(rows, last), "left").filter(F.col("last").isNull() | (time > F.col("last"))).select(rows.columns)
    tail = build.chunks_of(build.build(rest.withColumnRenamed("source", "device_source").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))))
    return kept.unionByName(tail.select(*[F.col(c).cast(t) for c, t in (x.split() for x in CHUNKS.split(", "))]))


def stream_period_totals(chunks: DataFrame, period: str = "day", delay: str = "1 day") -> DataFrame:
    """Totals of a period's parts of chunks (stateful.TOTALS), each period once the watermark has passed it, and parts that
    came later apart. Run it with run_stateful."""
    return period_steps(split(chunks, period), {"hour": "1 HOUR", "day": "1 DAY", "week": "7 DAY"}[period], delay)


def open_totals(spark: SparkSession, state: str) -> DataFrame:
    """Totals of the periods that are still open, read from the stream's state."""
    rows = spark.read.format("statestore").option("path", state).option("stateVarName", "total").load()
    return rows.select("key.start", "key.name", F.lit("open").alias("kind"), F.col("value.seconds").alias("total_seconds"), F.col("value.parts").alias("parts"))
