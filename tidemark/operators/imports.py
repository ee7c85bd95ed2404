"""An import as one operation: what is new goes in, chunks are built again, and a summary a tenant says what happened."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize
from . import build, merge, phone


@dataclass(frozen=True)
class Import:
    """events after the import, what build() makes of them, and a summary for each tenant of the import. What is judged about
    the incoming keys and what is built are stored once, until close()."""

    events: DataFrame
    built: DataFrame
    summary: DataFrame
    stored: tuple[DataFrame, ...] = ()

    def chunks(self) -> DataFrame:
        return build.chunks_of(self.built)

    def warnings(self) -> DataFrame:
        return build.warnings_of(self.built)

    def close(self) -> None:
        """Delete the stored tables, once nothing more is read from them."""
        for table in self.stored:
            discard(table)


def import_events(stored: DataFrame, incoming: DataFrame, apart: Sequence[str] = ()) -> Import:
    """Append the new events and rebuild. Only tables of the scratch folder are written, so the same serves as a preview; sinks
    are in readers. Equal events that differ in an expression of `apart` are all appended (merge.judge_incoming).

    summary: tenant_id, total, new and duplicates of the import, first and last time, chunks and warnings afterwards."""
    judged = materialize(merge.judge_incoming(stored, incoming, apart), "judged")
    events = stored.unionByName(judged.filter("NOT known").select("first.*").select(stored.columns))
    built = materialize(build.build(events), "built")
    counts = judged.groupBy(F.col("first.tenant_id").alias("tenant_id")).agg(
        F.sum("n").alias("total"),
        F.min("first.timestamp").alias("first_timestamp"),
        F.max("first.timestamp").alias("last_timestamp"),
        F.count(F.when(F.col("new"), 1)).alias("new"),
    )
    is_chunk = (F.col("kind") == "chunk") & (F.col("end_timestamp") >= F.col("start_timestamp"))
    made = built.groupBy("tenant_id").agg(F.count(F.when(is_chunk, 1)).alias("chunks"), F.count(F.when(~is_chunk, 1)).alias("warnings"))
    summary = counts.withColumn("duplicates", F.col("total") - F.col("new")).join(made, "tenant_id", "left")
    return Import(events, built, summary.na.fill(0, ["chunks", "warnings"]), (judged, built))


def phone_summary(log: DataFrame, ignored: DataFrame, strategy: str = "active_screen", least: int = phone.MIN_SECONDS) -> DataFrame:
    """Per tenant of a phone log (tenant_id, seq, ts, event): intervals, those too short, STARTs without an END, anomalies,
    seconds of unknown state and ignored events (tenant_id, event, ignored)."""
    if strategy == "active_screen":
        spans = phone.active_intervals(log)
        orphans = None
    else:
        kinds = phone.single_signal(log, strategy)
        spans = phone._neighbour(kinds.filter("kind = 'interval_start'").unionByName(kinds.filter("kind = 'interval_end'")).withColumn("on", F.col("kind") == "interval_start"), {"end_timestamp": "ts"}, ahead=True).filter("on and end_timestamp is not null")
        spans = spans.withColumn("start_timestamp", F.col("ts"))
        orphans = phone.pairing_audit(log, strategy).select("tenant_id", (F.col("duplicate_start") + F.col("open_at_end")).alias("orphan_starts"))
    short = F.timestamp_diff("SECOND", F.col("start_timestamp"), F.col("end_timestamp")) < least
    found = spans.groupBy("tenant_id").agg(F.count(F.when(~short, 1)).alias("intervals"), F.count(F.when(short, 1)).alias("dropped_short"))
    parts = [found, phone.anomalies(log).groupBy("tenant_id").agg(F.count("*").alias("anomalies")), phone.unknown_seconds(log), ignored.groupBy("tenant_id").agg(F.sum("ignored").alias("ignored"))]
    out = log.select("tenant_id").distinct()
    for part in [*parts, *([orphans] if orphans is not None else [])]:
        out = out.join(part, "tenant_id", "left")
    out = out if orphans is not None else out.withColumn("orphan_starts", F.lit(0).cast("long"))
    return out.na.fill(0)
