"""Processors of keyed streams with state in RocksDB: interval construction and totals of periods.

Neither loses a row that comes late: the event time is copied for the watermark and the copy is dropped before the rows are
grouped, so Spark filters none of them, and the processors hand late rows out beside their results.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind is chunk, duplicate_start, orphan_end, mismatch or late; a late event stands in the start or the end columns.
STEPS = "tenant_id long, source string, kind string, start_event_id long, start_timestamp timestamp, end_event_id long, end_timestamp timestamp, category string, name string"
#: kind is final (a period that the watermark has passed) or late (what came after that).
TOTALS = "start timestamp, name string, kind string, total_seconds long, parts long"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; the session gets its own setting back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def watched(df: DataFrame, time: str, delay: str) -> DataFrame:
    """df under a watermark on its time, with its late rows."""
    return df.withColumn("_clock", F.col(time).cast("timestamp")).withWatermark("_clock", delay).select(df.columns)


def _micros(column: pd.Series) -> list[int]:
    return column.astype("datetime64[us]").astype("int64").tolist()


def _time(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _stored(micros: int) -> datetime:
    return datetime.fromtimestamp(micros // 1_000_000, timezone.utc).replace(microsecond=micros % 1_000_000)


def _wake(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """One timer a key, the earliest one."""
    timers = list(handle.listTimers())
    if not timers or at_ms < min(timers):
        for timer in timers:
            handle.deleteTimer(timer)
        handle.registerTimer(at_ms)


#: Tenants whose keys share a state: what a call to the state costs is paid once for their keys.
TENANTS = 16
_IDLE = (-(1 << 62), 0, False, None, None, None, None)


class Intervals(StatefulProcessor):
    """The state machines of the sources of some tenants: events wait in a list until the watermark passes them, and are then
    taken in (time, id) order of their key. One that belongs before the last event taken of its key is late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "tenant_id long, source string, ts long, id long, is_start boolean, category string, name string")
        self.reached = handle.getListState("reached", "tenant_id long, source string, ts long, id long, open boolean, start_ts long, start_id long, category string, name string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            times = _micros(pdf["timestamp"])
            tenants = [None if pd.isna(x) else int(x) for x in pdf["tenant_id"]]
            is_start = (pdf["event_kind"] == "interval_start").tolist()
            events = list(zip(tenants, _texts(pdf["device_source"]), times, pdf["id"].tolist(), is_start, _texts(pdf["category"]), _texts(pdf["name"]), strict=True))
            if events:
                self.waiting.appendList(events)
                first = min(times) if first is None else min(first, *times)
        if first is not None:
            _wake(self.handle, first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = {}, []
        for e in self.waiting.get():
            if e[2] < passed:
                ready.setdefault(tuple(e[:2]), []).append(tuple(e[2:]))
            else:
                rest.append(tuple(e))
        if rest:
            self.waiting.put(rest)
            _wake(self.handle, min(e[2] for e in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        if ready:
            reached = {tuple(r[:2]): tuple(r[2:]) for r in self.reached.get()} if self.reached.exists() else {}
            out = []
            for own, events in ready.items():
                steps, reached[own] = fold(sorted(events, key=lambda e: e[:2]), reached.get(own, _IDLE))
                out += [(*own, *s) for s in steps]
            self.reached.put([(*own, *state) for own, state in reached.items()])
            if out:
                yield _frame(out)


def _texts(column: pd.Series) -> list[str | None]:
    return [None if pd.isna(x) else x for x in column]


def fold(events: list[tuple], state: tuple) -> tuple[list[tuple], tuple]:
    """(kind, start id, start time, end id, end time, category, name) of events in order, and the state after them."""
    ts, last, is_open, start_ts, start_id, category, name = state
    steps = []
    for at, number, is_start, cat, nam in events:
        own = (None, None, number, at, cat, nam)
        if (at, number) <= (ts, last):
            steps.append(("late", number, at, None, None, cat, nam) if is_start else ("late", *own))
            continue
        ts, last = at, number
        if is_start and not is_open:
            is_open, start_ts, start_id, category, name = True, at, number, cat, nam
        elif is_start:
            steps.append(("duplicate_start", number, at, None, None, cat, nam))
        elif not is_open:
            steps.append(("orphan_end", *own))
        elif (cat, nam) != (category, name):
            steps.append(("mismatch", start_id, start_ts, number, at, cat, nam))
        else:
            steps.append(("chunk", start_id, start_ts, number, at, cat, nam))
            is_open, start_ts, start_id, category, name = False, None, None, None, None
    return steps, (ts, last, is_open, start_ts, start_id, category, name)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")]).astype({"tenant_id": "Int64"})
    for c in ("start_timestamp", "end_timestamp"):
        pdf[c] = pd.to_datetime(pdf[c].astype("Int64"), unit="us")
    return pdf.astype({"start_event_id": "Int64", "end_event_id": "Int64"})


def interval_steps(events: DataFrame, delay: str) -> DataFrame:
    """STEPS of a stream of start and end events."""
    kept = events.filter(F.col("event_kind").isin("interval_start", "interval_end")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    kept = kept.withColumn("tenants", F.floor(F.col("tenant_id") / TENANTS))
    return watched(kept, "timestamp", delay).groupBy("tenants").transformWithStateInPandas(Intervals(), STEPS, "Append", "EventTime")


class Totals(StatefulProcessor):
    """Sum and count of a period's parts, given out and forgotten when the watermark passes the period's end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "seconds long, parts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seconds, parts = 0, 0
        for pdf in rows:
            seconds, parts = seconds + int(pdf["duration_seconds"].sum()), parts + len(pdf)
        if parts and _ms(key[1]) <= timerValues.getCurrentWatermarkInMs() and not self.total.exists():
            yield self._row(key, "late", seconds, parts)
        elif parts:
            before = self.total.get() if self.total.exists() else (0, 0)
            self.total.update((before[0] + seconds, before[1] + parts))
            _wake(self.handle, _ms(key[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.total.exists():
            seconds, parts = self.total.get()
            self.total.clear()
            yield self._row(key, "final", seconds, parts)

    def _row(self, key, kind: str, seconds: int, parts: int) -> pd.DataFrame:
        return pd.DataFrame({"start": [pd.Timestamp(key[0]).tz_localize(None)], "name": [key[2]], "kind": [kind], "total_seconds": [seconds], "parts": [parts]})


def _ms(time) -> int:
    return int(pd.Timestamp(time).value // 1_000_000)


#: Groups that the parts of one period and name are dealt to, as no sum is made before the shuffle.
DEAL = 8


def period_steps(parts: DataFrame, step: str, delay: str) -> DataFrame:
    """TOTALS of a stream of parts (period, start_timestamp, duration_seconds, name), each inside one period of the length
    `step`. A period and name gives some rows of each kind, which add up."""
    timed = parts.select(F.col("period").cast("timestamp").alias("start"), (F.col("period").cast("timestamp") + F.expr(f"INTERVAL {step}")).alias("end"), "name", F.col("start_timestamp").cast("timestamp").alias("at"), "duration_seconds")
    dealt = timed.withColumn("deal", F.pmod(F.xxhash64("at", "duration_seconds"), F.lit(DEAL)))
    return watched(dealt, "at", delay).groupBy("start", "end", "name", "deal").transformWithStateInPandas(Totals(), TOTALS, "Append", "EventTime")
