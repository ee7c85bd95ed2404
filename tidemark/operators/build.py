"""Interval construction: the start/end state machine over each tenant's and source's events.

START opens an interval when none is open, else it is a duplicate. END closes the open interval if its category and name
are the same (nulls equal nulls), else it is a mismatch and the interval stays open; without an open one it is an orphan.

Events are shuffled once, to buckets of a key and a day (cut further after BUCKET events). A start leads to the start that
follows its end, so what a bucket does to a state is a chain of jumps, found for all buckets of a batch at once:

1. each bucket's effect: the state after it for an idle entry, and for each label that it has an end of;
2. the entry state of each bucket, from one scan over the effects of a key in time order;
3. all buckets again, in parallel, from their entry states.

So a key of any size is spread over its days, and no task holds a key's events or effects at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("tenant_id", "source")
#: Events of one bucket, and of one portion of a task's stream, at most.
BUCKET, PORTION = 1_000, 50_000
_STATE = "struct<id: bigint, ts: timestamp_ntz, category: string, name: string>"
#: kind is chunk, duplicate_start, orphan_end, mismatch or unclosed.
OUT = "tenant_id long, source string, kind string, start_event_id long, start_timestamp timestamp_ntz, end_event_id long, end_timestamp timestamp_ntz, category string, name string, open_category string, open_name string"
_BUCKETS = f"tenant_id long, source string, day date, part int, ts array<timestamp_ntz>, id array<long>, is_start array<boolean>, category array<string>, name array<string>, idle {_STATE}, labels array<struct<category: string, name: string>>, after array<{_STATE}>"

_TIME = pa.timestamp("us")
_STATE_TYPE = pa.struct([("id", pa.int64()), ("ts", _TIME), ("category", pa.string()), ("name", pa.string())])
_KINDS = pa.array(["chunk", "duplicate_start", "orphan_end", "mismatch", "unclosed"])
_OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def codes(*columns: pa.Array) -> np.ndarray:
    """Equal numbers for equal rows of the columns; nulls are equal."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        found = pc.dictionary_encode(c, null_encoding="encode")
        out = out * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False)
    return out


class Jumps:
    """Events of many buckets, one after another in time order, and where the state machine jumps from each start.

    Place n stands for the idle state."""

    def __init__(self, bounds: np.ndarray, is_start: np.ndarray, label: np.ndarray):
        n = len(is_start)
        self.n, self.bounds = n, bounds
        self.bucket = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        place = np.arange(n)
        # the next start at or after each place, inside its bucket
        self.start_from = np.append(np.minimum.accumulate(np.where(is_start, place, n)[::-1])[::-1], n)
        inside = self.start_from[:n] < n
        inside[inside] = self.bucket[self.start_from[:n][inside]] == self.bucket[inside]
        self.start_from[:n][~inside] = n
        # the next end of the same label
        order = np.lexsort((label, self.bucket))
        group = np.ones(n, np.int64)
        group[1:] = (self.bucket[order][1:] != self.bucket[order][:-1]) | (label[order][1:] != label[order][:-1])
        self.group_starts = np.flatnonzero(group)
        group = np.cumsum(group) - 1
        near = np.minimum.accumulate(np.where(is_start[order], n, place)[::-1])[::-1]
        ends = np.where((near < n) & (group[np.minimum(near, n - 1)] == group), order[np.minimum(near, n - 1)], -1)
        self.end_of = np.full(n, -1)
        self.end_of[order] = ends
        #: Of each bucket and label: first event, and first end (-1: none).
        self.group_event, self.group_end = order[self.group_starts], ends[self.group_starts]
        self.next = np.append(np.where(self.end_of >= 0, self.idle_from(self.end_of), place), n)

    def idle_from(self, end: np.ndarray) -> np.ndarray:
        """The start after each end (n: none in its bucket)."""
        after = np.where(end >= 0, end + 1, self.n)
        inside = (after < self.n) & (end >= 0)
        inside[inside] = self.bucket[after[inside]] == self.bucket[end[inside]]
        return np.where(inside, self.start_from[after], self.n)

    def first_starts(self) -> np.ndarray:
        return self.start_from[self.bounds[:-1]]

    def last(self) -> np.ndarray:
        """The start that is open at the bucket's end after each start's chain (n: idle)."""
        jump = self.next
        while True:
            further = jump[jump]
            if (further == jump).all():
                return jump
            jump = further

    def chains(self, roots: np.ndarray) -> np.ndarray:
        """Which places are starts on the chains from the roots."""
        on = np.zeros(self.n + 1, bool)
        on[roots] = True
        jump = self.next
        while True:
            further = on.copy()
            further[jump[np.flatnonzero(on)]] = True
            if (further == on).all():
                return on[: self.n]
            on, jump = further, jump[jump]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Portions of a stream sorted by key, day and time, and each row's place in its key and day. They hold whole buckets, so that
    where a bucket begins follows from its key and day alone: a portion's last one, which may go on, waits for the next."""
    held: list[pa.RecordBatch] = []
    before = 0  # events of the first held row's key and day that went out already
    for batch in chain(batches, [None]):
        held += [batch] if batch is not None and batch.num_rows else []
        if not held or (batch is not None and sum(b.num_rows for b in held) < PORTION):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.num_rows
        key = codes(*(table.column(c) for c in ("tenant_id", "source", "day")))
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        group = np.append(np.flatnonzero(new), n)
        inside = np.arange(n) - np.repeat(group[:-1], np.diff(group))
        inside[: group[1]] += before
        cut = n if batch is None else int(np.flatnonzero(inside % BUCKET == 0)[-1])
        if cut:
            yield table.slice(0, cut), inside[:cut]
        if cut < n:
            held, before = table.slice(cut).to_batches(), int(inside[cut])


def _states(places: np.ndarray, table: dict[str, pa.Array]) -> pa.Array:
    """The starts at the given places as states (place n: null)."""
    idle = places >= len(table["id"])
    at = pa.array(np.where(idle, 0, places), mask=idle)
    return pa.StructArray.from_arrays([table[c].take(at) for c in ("id", "ts", "category", "name")], fields=list(_STATE_TYPE), mask=pa.array(idle))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a stream sorted by key, day and time, with what each does to the state that it is entered with."""
    for table, inside in _portions(batches):
        column = {c: table.column(c).combine_chunks() if isinstance(table.column(c), pa.ChunkedArray) else table.column(c) for c in table.column_names}
        n, part = table.num_rows, inside // BUCKET
        bounds = np.append(np.flatnonzero(inside % BUCKET == 0), n)
        is_start = column["is_start"].to_numpy(zero_copy_only=False)
        jumps = Jumps(bounds, is_start, codes(column["category"], column["name"]))
        last = jumps.last()
        ended = jumps.group_end >= 0
        at = pa.array(jumps.group_event[ended])
        labels = pa.StructArray.from_arrays([column["category"].take(at), column["name"].take(at)], names=["category", "name"])
        after = _states(last[jumps.idle_from(jumps.group_end[ended])], column)
        label_bounds = pa.array(np.searchsorted(jumps.bucket[jumps.group_event[ended]], np.arange(len(bounds))), pa.int32())
        event_bounds, heads = pa.array(bounds, pa.int32()), pa.array(bounds[:-1])
        lists = [pa.ListArray.from_arrays(event_bounds, column[c]) for c in ("ts", "id", "is_start", "category", "name")]
        yield pa.RecordBatch.from_arrays(
            [*(column[c].take(heads) for c in ("tenant_id", "source", "day")), pa.array(part[bounds[:-1]], pa.int32()), *lists, _states(last[jumps.first_starts()], column), pa.ListArray.from_arrays(label_bounds, labels), pa.ListArray.from_arrays(label_bounds, after)],
            ["tenant_id", "source", "day", "part", "ts", "id", "is_start", "category", "name", "idle", "labels", "after"],
        )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state with which each bucket is entered, and whether it is its key's last one; the stream is in order."""
    key, state, held = None, None, None
    for batch in batches:
        tenant, source, idle = (batch.column(c).to_pylist() for c in ("tenant_id", "source", "idle"))
        labels, after = batch.column("labels"), batch.column("after")
        flat, bounds = labels.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(labels).to_numpy(zero_copy_only=False))]).tolist()
        categories, names, states = flat.field("category").to_pylist(), flat.field("name").to_pylist(), after.flatten()
        entries, rows, finals = [], [], []
        for k in range(batch.num_rows):
            if (tenant[k], source[k]) != key:
                if held is not None:
                    yield _entry_batch(*held, True)
                    held = None
                key, state = (tenant[k], source[k]), None
                if rows:
                    finals[-1] = True
            entries.append(state)
            rows.append(k)
            finals.append(False)
            if held is not None:  # the batch before ended inside this key
                yield _entry_batch(*held, False)
                held = None
            if state is None:
                state = idle[k]
            else:
                found = next((j for j in range(bounds[k], bounds[k + 1]) if categories[j] == state["category"] and names[j] == state["name"]), None)
                state = state if found is None else states[found].as_py()
        if rows:
            # whether the last bucket is its key's last is known later
            held = (batch.slice(rows[-1], 1), entries[-1:])
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[:-1] for c in ("tenant_id", "source", "day", "part")), pa.array(entries[:-1], _STATE_TYPE), pa.array(finals[:-1], pa.bool_())], _ENTRY)
    if held is not None:
        yield _entry_batch(*held, True)


_ENTRY = ["tenant_id", "source", "day", "part", "entry", "final"]


def _entry_batch(row: pa.RecordBatch, entry: list, final: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(row.column(c) for c in ("tenant_id", "source", "day", "part")), pa.array(entry, _STATE_TYPE), pa.array([final])], _ENTRY)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of whole buckets with PORTION events, or with one bucket more."""
    if not batch.num_rows:
        return
    before = np.cumsum(pc.list_value_length(batch.column("ts")).to_numpy(zero_copy_only=False)) // PORTION
    cuts = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(at, end - at)


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks and warnings of buckets entered with known states."""
    for batch in (part for whole in batches for part in _pieces(whole)):
        column = {c: batch.column(c).flatten() for c in ("ts", "id", "is_start", "category", "name")}
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("ts")).to_numpy(zero_copy_only=False))]).astype(np.int64)
        entry = batch.column("entry")
        opened = entry.is_valid().to_numpy(zero_copy_only=False)
        state = {c: pc.struct_field(entry, c) for c in ("id", "ts", "category", "name")}
        n = int(bounds[-1])
        label = codes(*(pa.concat_arrays([column[c], state[c]]) for c in ("category", "name")))
        jumps = Jumps(bounds, column["is_start"].to_numpy(zero_copy_only=False), label[:n])
        # where the interval that is open on entry ends: the first end of its label
        until = np.full(batch.num_rows, n)
        buckets = jumps.bucket[jumps.group_event]
        same = opened[buckets] & (label[jumps.group_event] == label[n:][buckets]) & (jumps.group_end >= 0)
        until[buckets[same]] = jumps.group_end[same]
        roots = np.where(opened, np.where(until < n, jumps.idle_from(np.where(until < n, until, -1)), n), jumps.first_starts())
        chain = jumps.chains(roots)
        place = np.arange(n)
        begun = np.maximum.accumulate(np.where(chain, place, -1))
        covered = (begun >= 0) & ~chain
        covered[covered] = jumps.bucket[begun[covered]] == jumps.bucket[covered]
        end = jumps.end_of[np.maximum(begun, 0)]
        covered &= (end < 0) | (place <= end)
        carried = opened[jumps.bucket] & (place <= until[jumps.bucket])
        is_start = column["is_start"].to_numpy(zero_copy_only=False)
        closes = (covered & (place == end)) | (carried & (place == until[jumps.bucket]))
        kind = np.where(is_start, 1, np.where(closes, 0, np.where(covered | carried, 3, 2)))
        shown = np.flatnonzero(~chain)
        # the interval that is open there: a start of the bucket, or the state on entry (places after n)
        holder = np.where(carried, n + jumps.bucket, np.where(covered, begun, -1))[shown]
        stays = opened & (until == n)
        last = np.where(stays, n + np.arange(batch.num_rows), jumps.last()[roots])
        left_open = np.flatnonzero(batch.column("final").to_numpy(zero_copy_only=False) & (stays | (last < n)))
        both = {c: pa.concat_arrays([column[c], state[c]]) for c in ("id", "ts", "category", "name")}
        yield _rows(batch, jumps.bucket[shown], kind[shown], place[shown], is_start[shown], holder, both)
        if len(left_open):
            yield _rows(batch, left_open, np.full(len(left_open), 4), last[left_open], np.ones(len(left_open), bool), np.full(len(left_open), -1), both)


def _rows(batch: pa.RecordBatch, bucket: np.ndarray, kind: np.ndarray, place: np.ndarray, is_start: np.ndarray, holder: np.ndarray, both: dict[str, pa.Array]) -> pa.RecordBatch:
    """OUT rows: a start stands in the start columns, an end in the end columns with the interval that it meets."""
    at, open_at, own = pa.array(place), pa.array(np.maximum(holder, 0), mask=holder < 0), pa.array(bucket)
    starts = pa.array(np.where(is_start, place, np.maximum(holder, 0)), mask=~is_start & (holder < 0))
    ends = pa.array(place, mask=is_start)
    columns = [batch.column("tenant_id").take(own), batch.column("source").take(own), _KINDS.take(pa.array(kind))]
    columns += [both["id"].take(starts), both["ts"].take(starts), both["id"].take(ends), both["ts"].take(ends)]
    columns += [both["category"].take(at), both["name"].take(at), both["category"].take(open_at), both["name"].take(open_at), batch.column("day").take(own)]
    return pa.RecordBatch.from_arrays(columns, [*_OUT_NAMES, "day"])


_DAY = (*KEY, "day")
_ENTRIES = f"tenant_id long, source string, day date, part int, entry {_STATE}, final boolean"


def bucket_rows(events: DataFrame) -> DataFrame:
    """The start and end events as buckets take them, with their day."""
    is_start = (F.col("event_kind") == "interval_start").alias("is_start")
    kept = events.filter(F.col("event_kind").isin("interval_start", "interval_end"))
    return kept.select(F.col("tenant_id").cast("long").alias("tenant_id"), F.col("device_source").alias("source"), F.to_date("timestamp").alias("day"), F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.col("id").cast("long").alias("id"), is_start, "category", "name")


def buckets(rows: DataFrame) -> DataFrame:
    """Buckets of bucket_rows with their effects."""
    return rows.repartition(*_DAY).sortWithinPartitions(*_DAY, "ts", "id").mapInArrow(_effects, _BUCKETS)


def effects_of(found: DataFrame) -> DataFrame:
    return found.select(*_DAY, "part", "idle", "labels", "after")


def entries(effects: DataFrame) -> DataFrame:
    """The state on entry to each bucket, from the effects of all buckets of a key."""
    return effects.repartition(*KEY).sortWithinPartitions(*_DAY, "part").mapInArrow(_entries, _ENTRIES)


def results(found: DataFrame, entry: DataFrame) -> DataFrame:
    """Chunks and warnings of buckets, with the day of the bucket in which each was decided."""
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*_DAY, "part")]
    entered = found.drop("idle", "labels", "after").join(entry.withColumnsRenamed({c: f"_{c}" for c in (*_DAY, "part")}), same)
    return entered.mapInArrow(_results, f"{OUT}, day date")


def build(events: DataFrame) -> DataFrame:
    """All chunks and warnings of events (tenant_id, id, timestamp, device_source, event_kind, category, name)."""
    found = buckets(bucket_rows(events))
    return results(found, entries(effects_of(found))).drop("day")


def chunks_of(built: DataFrame) -> DataFrame:
    """Chunks with a duration; an interval that ends before it starts is none. The start event's id names the chunk."""
    d = F.timestamp_diff("SECOND", F.col("start_timestamp"), F.col("end_timestamp"))
    return built.filter("kind = 'chunk'").select("tenant_id", F.col("start_event_id").alias("id"), "start_timestamp", "end_timestamp", d.alias("duration_seconds"), "category", "name", "source", "start_event_id", "end_event_id").filter("duration_seconds >= 0")


def warnings_of(built: DataFrame) -> DataFrame:
    text = (
        F.when(F.col("kind") == "duplicate_start", F.concat(F.lit("Duplicate start on "), "source"))
        .when(F.col("kind") == "orphan_end", F.concat(F.lit("End without start on "), "source"))
        .when(F.col("kind") == "mismatch", F.concat(F.lit("Mismatched end on "), "source"))
        .when(F.col("kind") == "unclosed", F.concat(F.lit("Unclosed interval on "), "source"))
        .otherwise(F.concat(F.lit("Negative duration on "), "source"))
    )
    bad = (F.col("kind") != "chunk") | (F.col("end_timestamp") < F.col("start_timestamp"))
    return built.filter(bad).select("tenant_id", "source", "kind", F.coalesce("end_event_id", "start_event_id").alias("event_id"), text.alias("message"))


def state_issues(built: DataFrame) -> DataFrame:
    """The same pass as validation issues; a mismatch of category and one of activity are two issues."""
    event = F.coalesce("end_event_id", "start_event_id")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    kind = F.col("kind")
    issue = lambda severity, message: F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    issues = F.array_compact(
        F.array(
            F.when(kind == "duplicate_start", issue("ERROR", "start while another interval is active")),
            F.when(kind == "orphan_end", issue("ERROR", "end without an active interval")),
            F.when((kind == "mismatch") & differs("category", "open_category"), issue("ERROR", "end has another category")),
            F.when((kind == "mismatch") & differs("name", "open_name"), issue("ERROR", "end has another activity")),
            F.when((kind == "chunk") & (F.col("end_timestamp") < F.col("start_timestamp")), issue("ERROR", "end before start")),
            F.when(kind == "unclosed", issue("WARNING", "interval is still open")),
        )
    )
    return built.select("tenant_id", event.alias("object_id"), F.explode(issues).alias("i")).select("tenant_id", "i.severity", F.lit("events").alias("table"), "object_id", "i.message")
