"""Whole reports on a phone's signals: intervals with what ended them, repeats, unknown ranges, anomalies, pairings.

Each report comes from one computation of the states, which is stored once; its rows say in `output` (or `kind`) what they are.
`seq` is the row at which something begins or happens, `until_seq` the row that ends it (null where the range does).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from . import phone
from .carry import last_known

REPORT = ("tenant_id", "output", "seq", "until_seq", "start_timestamp", "end_timestamp", "reason")


def _range(start: datetime, end: datetime) -> tuple[Column, Column]:
    return F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")


def _clipped(spans: DataFrame, start: datetime, end: datetime) -> DataFrame:
    lo, hi = _range(start, end)
    cut = {"start_timestamp": F.greatest("start_timestamp", lo), "end_timestamp": F.least("end_timestamp", hi)}
    return spans.withColumns(cut).filter("start_timestamp < end_timestamp").select(*REPORT)


def _happened(rows: DataFrame, output: str, reason: Column) -> DataFrame:
    return rows.select("tenant_id", F.lit(output).alias("output"), "seq", F.lit(None).cast("long").alias("until_seq"), F.col("ts").alias("start_timestamp"), F.col("ts").alias("end_timestamp"), reason.alias("reason"))


def signal_report(log: DataFrame, on: str, off: str, start: datetime, end: datetime, *, off_at_first: bool = False) -> DataFrame:
    """REPORT rows of one signal up to `end`: `interval` (cut to the range; reason <on>_to_<off>, or open_at_range_end) and
    `repeat` (an event that sets what is set already). With off_at_first the signal counts as off before its first event, so an
    off event that comes first is a repeat, too, as for startups without a shutdown."""
    _, hi = _range(start, end)
    rows = log.filter(F.col("event").isin(on, off) & (F.col("ts") <= hi)).withColumn("is_on", F.col("event") == on)
    state = materialize(phone._neighbour(rows, {"was": "is_on"}), "signal")
    was = F.coalesce("was", F.lit(False)) if off_at_first else F.col("was")
    repeats = state.filter(was.eqNullSafe(F.col("is_on")))
    turns = phone._neighbour(state.filter(~F.coalesce("was", F.lit(False)).eqNullSafe(F.col("is_on"))), {"until": "ts", "until_seq": "seq"}, ahead=True)
    reason = F.when(F.col("until").isNull(), "open_at_range_end").otherwise(f"{on}_to_{off}")
    spans = turns.filter("is_on").select("tenant_id", F.lit("interval").alias("output"), "seq", "until_seq", F.col("ts").alias("start_timestamp"), F.coalesce("until", hi).alias("end_timestamp"), reason.alias("reason"))
    return _clipped(spans, start, end).unionByName(_happened(repeats, "repeat", F.concat(F.lit("repeated_"), F.lower("event"))))


def shutdown_report(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """signal_report of the time between shutdowns and startups."""
    return signal_report(log, "DEVICE_SHUTDOWN", "DEVICE_STARTUP", start, end, off_at_first=True)


def window_report(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """REPORT rows of the active screen: `interval` (reason stopped_by_<event> or stopped_by_range_end), `unknown` (ranges in
    which screen or lock are unknown; state_unknown or state_unknown_at_range_end) and `anomaly` (also before the range).

    Rows before the range set the state that it begins with, an interval or unknown range that is open there is cut to it."""
    _, hi = _range(start, end)
    state = materialize(phone.states(log.filter(F.col("ts") <= hi)), "states")
    turned = phone._neighbour(state.filter(~F.col("active").eqNullSafe(F.col("was"))), {"until": "ts", "until_seq": "seq", "until_event": "event"}, ahead=True)
    closed = F.col("until").isNotNull()
    spans = turned.filter("active IS NULL OR active").select(
        "tenant_id",
        F.when(F.col("active").isNull(), "unknown").otherwise("interval").alias("output"),
        "seq",
        "until_seq",
        F.col("ts").alias("start_timestamp"),
        F.coalesce("until", hi).alias("end_timestamp"),
        F.when(F.col("active").isNull() & closed, "state_unknown").when(F.col("active").isNull(), "state_unknown_at_range_end").when(closed, F.concat(F.lit("stopped_by_"), F.lower("until_event"))).otherwise("stopped_by_range_end").alias("reason"),
    )
    # the state is unknown before its first turn
    turn = F.when(~F.col("active").eqNullSafe(F.col("was")), F.struct("ts", "seq"))
    first = state.groupBy("tenant_id").agg(F.min(turn).alias("first"))
    before = first.select("tenant_id", F.lit("unknown").alias("output"), F.lit(None).cast("long").alias("seq"), F.col("first.seq").alias("until_seq"), F.lit(start).cast("timestamp_ntz").alias("start_timestamp"), F.coalesce("first.ts", hi).alias("end_timestamp"), F.when(F.col("first").isNull(), "state_unknown_at_range_end").otherwise("state_unknown").alias("reason"))
    found = _happened(_anomalous(state), "anomaly", F.col("anomaly"))
    return _clipped(spans.unionByName(before), start, end).unionByName(found)


def _anomalous(state: DataFrame) -> DataFrame:
    """Rows that set what is set already, with the name of that."""
    same = F.lit(False)
    for column, events in {"screen": phone.SIGNALS["screen"], "unlocked": phone.SIGNALS["keyguard"]}.items():
        same = same | (F.col("event").isin(*events) & F.col(f"was_{column}").isNotNull() & (F.col(f"was_{column}") == F.col(column)))
    down = F.coalesce("was_down", F.lit(False))
    kind = F.when((F.col("event") == "DEVICE_STARTUP") & ~down, "startup_without_shutdown").when(same | ((F.col("event") == "DEVICE_SHUTDOWN") & down), F.concat(F.lit("repeated_"), F.lower("event")))
    return state.withColumn("anomaly", kind).filter("anomaly IS NOT NULL")


def pairing_scan(log: DataFrame, strategy: str) -> DataFrame:
    """How one signal's STARTs and ENDs pair, raw (of STARTs in a row the first counts) and repaired (the last one does):
    tenant_id, form, kind (interval, duplicate_start, orphan_end, open_at_end), seq, until_seq, start_timestamp, end_timestamp,
    and for duplicates open_seq, the START that is open there."""
    on, off = phone.SIGNALS[strategy]
    rows = log.filter(F.col("event").isin(on, off)).withColumn("is_on", F.col("event") == on)
    near = phone._neighbour(phone._neighbour(rows, {"was": "is_on", "was_seq": "seq"}), {"next": "is_on"}, ahead=True)
    was = F.coalesce("was", F.lit(False))
    near = last_known(near, ["tenant_id"], ["ts", "seq"], {"run_seq": F.when(F.col("is_on") & ~was, F.col("seq"))})
    state = materialize(near, "pairing")
    none = {c: F.lit(None).cast(t) for c, t in (("until_seq", "long"), ("end_timestamp", "timestamp_ntz"), ("open_seq", "long"))}

    def shown(found: DataFrame, form: str, kind: Column, **given: Column) -> DataFrame:
        columns = none | given
        return found.select("tenant_id", F.lit(form).alias("form"), kind.alias("kind"), "seq", columns["until_seq"].alias("until_seq"), F.col("ts").alias("start_timestamp"), columns["end_timestamp"].alias("end_timestamp"), columns["open_seq"].alias("open_seq"))

    out = None
    for form in ("raw", "repaired"):
        counts = F.col("is_on") & (~was if form == "raw" else ~F.coalesce("next", F.lit(False)))
        ends = ~F.col("is_on") & was
        pairs = phone._neighbour(state.filter(counts | ends), {"until": "ts", "until_seq": "seq"}, ahead=True).filter("is_on")
        open_seq = F.col("run_seq") if form == "raw" else F.col("was_seq")
        parts = (
            shown(pairs, form, F.when(F.col("until_seq").isNull(), "open_at_end").otherwise("interval"), until_seq=F.col("until_seq"), end_timestamp=F.col("until")),
            shown(state.filter(F.col("is_on") & was), form, F.lit("duplicate_start"), open_seq=open_seq),
            shown(state.filter(~F.col("is_on") & ~was), form, F.lit("orphan_end")),
        )
        for part in parts:
            out = part if out is None else out.unionByName(part)
    return out
