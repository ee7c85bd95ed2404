"""A phone's signal log (tenant_id, seq, ts, event) to active-screen intervals, without Python on rows.

All neighbours and last known values spread a tenant over its days (see carry)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import last_known, neighbour

_ORDER = ("ts", "seq")
MIN_SECONDS = 20
#: Signals of one kind: start and end event.
SIGNALS = {"screen": ("SCREEN_INTERACTIVE", "SCREEN_NON_INTERACTIVE"), "keyguard": ("KEYGUARD_HIDDEN", "KEYGUARD_SHOWN")}
_KNOWN = (*SIGNALS["screen"], *SIGNALS["keyguard"], "DEVICE_SHUTDOWN", "DEVICE_STARTUP")


def _signal(on: str, off: str) -> Column:
    return F.when(F.col("event") == on, True).when(F.col("event") == off, False)


def _neighbour(df: DataFrame, columns: dict[str, str], *, ahead: bool = False) -> DataFrame:
    return neighbour(df, ["tenant_id"], list(_ORDER), columns, ahead=ahead)


def _active(screen: str, unlocked: str, down: str) -> Column:
    return F.when(F.col(down), False).when(F.col(screen).isNull() | F.col(unlocked).isNull(), None).otherwise(F.col(screen) & F.col(unlocked))


def states(log: DataFrame) -> DataFrame:
    """log with screen, unlocked, down and active after each row, and the same before it (was_screen, was_unlocked, was_down,
    was); active is null while screen or lock is unknown. was_seen is null in a tenant's first row."""
    known = log.filter(F.col("event").isin(*_KNOWN))
    values = {"screen": _signal(*SIGNALS["screen"]), "unlocked": _signal(*SIGNALS["keyguard"]), "down": _signal("DEVICE_SHUTDOWN", "DEVICE_STARTUP"), "seen": F.lit(True)}
    s = last_known(known, ["tenant_id"], list(_ORDER), values, before="was_")
    s = s.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("down", "was_down")})
    return s.withColumns({"active": _active("screen", "unlocked", "down"), "was": _active("was_screen", "was_unlocked", "was_down")}).drop("seen")


def active_intervals(log: DataFrame) -> DataFrame:
    """Active-screen intervals: tenant_id, seq of the start, start_timestamp, end_timestamp."""
    state = states(log)
    now, was = F.coalesce("active", F.lit(False)), F.coalesce("was", F.lit(False))
    ends = log.groupBy(F.col("tenant_id").alias("_tenant")).agg(F.max(F.when(F.col("event").isin(*_KNOWN), F.col("ts"))).alias("log_end"))
    turns = _neighbour(state.withColumn("turn", F.when(now != was, now)).filter("turn is not null"), {"following": "ts"}, ahead=True).filter("turn")
    closed = turns.join(ends, F.col("tenant_id").eqNullSafe(F.col("_tenant"))).withColumn("end_timestamp", F.coalesce("following", "log_end"))
    return closed.filter("following is not null or end_timestamp > ts").select("tenant_id", "seq", F.col("ts").alias("start_timestamp"), "end_timestamp")


def boundaries(log: DataFrame) -> DataFrame:
    """START and END rows of the active intervals, each with the seq of its interval's start."""
    ends = F.array(F.struct(F.col("start_timestamp").alias("ts"), F.lit("interval_start").alias("kind")), F.struct(F.col("end_timestamp").alias("ts"), F.lit("interval_end").alias("kind")))
    return active_intervals(log).select("tenant_id", "seq", F.explode(ends).alias("x")).select("tenant_id", "seq", "x.ts", "x.kind")


def drop_short(intervals: DataFrame, least: int = MIN_SECONDS) -> DataFrame:
    return intervals.filter(F.timestamp_diff("SECOND", F.col("start_timestamp"), F.col("end_timestamp")) >= least)


def anomalies(log: DataFrame) -> DataFrame:
    """Rows that repeat the state that they set, and startups without a shutdown."""
    s = states(log)
    same = F.lit(False)
    for column, (on, off) in {"screen": SIGNALS["screen"], "unlocked": SIGNALS["keyguard"]}.items():
        same = same | (F.col("event").isin(on, off) & F.col(f"was_{column}").eqNullSafe(F.col(column)) & F.col(column).isNotNull())
    kind = F.when((F.col("event") == "DEVICE_STARTUP") & ~F.col("was_down"), "startup_without_shutdown").when((F.col("event") == "DEVICE_SHUTDOWN") & F.col("was_down"), "repeated_state").when(same, "repeated_state")
    return s.withColumn("anomaly", kind).filter("anomaly is not null").select("tenant_id", "seq", "ts", "event", "anomaly")


def unknown_ranges(log: DataFrame, *, until: datetime | None = None) -> DataFrame:
    """Runs of rows whose active state is unknown, up to the next known row. A trailing run ends at `until`, or is left out."""
    s = states(log).withColumn("unknown", F.col("active").isNull())
    turns = _neighbour(s.filter(F.col("unknown") != (F.col("was_seen").isNotNull() & F.col("was").isNull())), {"end_timestamp": "ts"}, ahead=True)
    if until:
        turns = turns.withColumn("end_timestamp", F.coalesce("end_timestamp", F.lit(until).cast("timestamp_ntz")))
    return turns.filter("unknown and end_timestamp is not null").select("tenant_id", "seq", F.col("ts").alias("start_timestamp"), "end_timestamp")


def unknown_seconds(log: DataFrame) -> DataFrame:
    d = F.timestamp_diff("SECOND", F.col("start_timestamp"), F.col("end_timestamp"))
    return unknown_ranges(log).groupBy("tenant_id").agg(F.sum(d).alias("unknown_seconds"))


def single_signal(log: DataFrame, strategy: str) -> DataFrame:
    """START and END rows of one signal: of STARTs in a row only the last stays; ENDs all stay."""
    on, off = SIGNALS[strategy]
    rows = log.filter(F.col("event").isin(on, off)).withColumn("kind", F.when(F.col("event") == on, "interval_start").otherwise("interval_end"))
    return _neighbour(rows, {"following": "kind"}, ahead=True).filter("kind = 'interval_end' or following is null or following = 'interval_end'").select("tenant_id", "seq", "ts", "kind")


def signal_intervals(log: DataFrame, on: str, off: str, start: datetime, end: datetime) -> DataFrame:
    """Intervals in which a signal is on, cut to [start, end); one still on at the end is closed there."""
    rows = _neighbour(log.filter(F.col("event").isin(on, off)).withColumn("is_on", F.col("event") == on), {"was": "is_on"})
    turns = _neighbour(rows.filter(F.col("is_on") != F.coalesce("was", F.lit(False))), {"until": "ts"}, ahead=True)
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    spans = turns.filter("is_on").withColumn("until", F.coalesce("until", hi))
    return spans.select("tenant_id", "seq", F.greatest("ts", lo).alias("start_timestamp"), F.least("until", hi).alias("end_timestamp")).filter("start_timestamp < end_timestamp")


def windowed(log: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Active intervals inside [start, end): rows before start set the state only. stop says what ended each one."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    s = states(log.filter(F.col("ts") < hi))
    now, was = F.coalesce("active", F.lit(False)), F.coalesce("was", F.lit(False))
    turns = s.withColumn("turn", F.when(now != was, now)).filter("turn is not null")
    ended = _neighbour(turns, {"end_timestamp": "ts", "stop": "event"}, ahead=True).filter("turn")
    ended = ended.withColumns({"end_timestamp": F.coalesce("end_timestamp", hi), "stop": F.coalesce("stop", F.lit("WINDOW_END"))})
    return ended.select("tenant_id", "seq", F.greatest("ts", lo).alias("start_timestamp"), "end_timestamp", "stop").filter("start_timestamp < end_timestamp")


def pairing_audit(log: DataFrame, strategy: str) -> DataFrame:
    """Per tenant: STARTs in a row, ENDs without a START, and whether the log ends open."""
    on, off = SIGNALS[strategy]
    rows = _neighbour(log.filter(F.col("event").isin(on, off)).withColumn("is_on", F.col("event") == on), {"was": "is_on"})
    last = F.max_by("is_on", F.struct(*_ORDER))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy("tenant_id").agg(count(F.col("is_on") & F.col("was")).alias("duplicate_start"), count(~F.col("is_on") & ~F.coalesce("was", F.lit(False))).alias("orphan_end"), F.when(last, 1).otherwise(0).cast("long").alias("open_at_end"))
