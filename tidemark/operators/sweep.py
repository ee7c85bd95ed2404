"""Overlapping pairs of intervals by a sweep, with work in proportion to rows and pairs.

Of two overlapping intervals one starts inside the other. Inside one key and day both sides are sorted by start, so the
intervals that start inside a given one are a stretch of the other side, found by binary search for all intervals of many keys
at once. No pair is looked at that doesn't overlap, however dense a day is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of whole groups that are swept at once, and pairs that leave a task at once.
ROWS, PAIRS = 65_536, 262_144
_DAY = 86_400_000_000  # microseconds
_SPAN = 1 << 37  # holds a day


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, left_id, right_id, start_timestamp, end_timestamp for each pair of a left and a right interval of equal keys that
    share time; rows with a null key or no length have no pair."""
    known = " AND ".join([*[f"`{k}` IS NOT NULL" for k in keys], "start_timestamp < end_timestamp"])

    def side(df: DataFrame, own: str, other: str, other_type: str, is_left: bool) -> DataFrame:
        first, last = F.floor(_micros("start_timestamp") / F.lit(_DAY)), F.floor((_micros("end_timestamp") - 1) / F.lit(_DAY))
        ids = {own: F.col("id"), other: F.lit(None).cast(other_type)}
        return df.filter(known).select(*keys, F.lit(is_left).alias("is_left"), ids["left_id"].alias("left_id"), ids["right_id"].alias("right_id"), _micros("start_timestamp").alias("start"), _micros("end_timestamp").alias("end"), F.explode(F.sequence(first, last)).alias("day"))

    types = {name: dict(df.dtypes)["id"] for name, df in (("left_id", left), ("right_id", right))}
    rows = side(left, "left_id", "right_id", types["right_id"], True).unionByName(side(right, "right_id", "left_id", types["left_id"], False))
    rows = rows.select(*keys, "day", "start", "end", "is_left", "left_id", "right_id")
    n = len(keys)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, n + 1):
            for a, b in _pairs(table, n):
                starts, ends = table.column("start").to_numpy(), table.column("end").to_numpy()
                start, end = np.maximum(starts[a], starts[b]), np.minimum(ends[a], ends[b])
                one, two = pa.array(a), pa.array(b)
                columns = [table.column(k).take(one) for k in keys] + [table.column("left_id").take(one), table.column("right_id").take(two), pa.array(start), pa.array(end)]
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "left_id", "right_id", "start", "end"])

    kinds = dict(left.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"left_id {types['left_id']}", f"right_id {types['right_id']}", "start long", "end long"])
    pairs = rows.repartition(*keys, "day").sortWithinPartitions(*keys, "day", "start").mapInArrow(sweep, schema)
    time = lambda c, kind: F.timestamp_micros(c).cast(kind)
    return pairs.select(*keys, "left_id", "right_id", time("start", kinds["start_timestamp"]).alias("start_timestamp"), time("end", kinds["end_timestamp"]).alias("end_timestamp"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups (equal first `keys` columns, none of them null) of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(new_groups(table, keys))[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def new_groups(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in range(keys):
        column = table.column(k)
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
    return new


def _pairs(table: pa.Table, keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of overlapping left and right intervals. A pair counts in the day in which its overlap starts, so an interval from
    an earlier day may hold others but starts in none."""
    group = np.cumsum(new_groups(table, keys + 1)) * _SPAN
    begin = table.column("day").to_numpy() * _DAY
    start, end = table.column("start").to_numpy() - begin, np.minimum(table.column("end").to_numpy() - begin, _DAY)
    is_left = table.column("is_left").to_numpy()
    here = start >= 0
    for holders, starters, after in ((is_left, ~is_left & here, 0), (~is_left, is_left & here, 1)):
        hold, inner = np.flatnonzero(holders), np.flatnonzero(starters)
        place = group[inner] + start[inner]
        # of two that start together, the left one holds the right one
        low = np.searchsorted(place, group[hold] + np.where(here[hold], start[hold] + after, 0))
        count = np.maximum(np.searchsorted(place, group[hold] + end[hold]) - low, 0)
        for some in _portions(count):
            row = np.repeat(hold[some], count[some])
            at = np.repeat(low[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(int(count[some].sum()))
            yield (row, inner[at]) if after == 0 else (inner[at], row)


def _portions(count: np.ndarray) -> Iterator[slice]:
    """Stretches of holders with about PAIRS pairs."""
    total, at = np.cumsum(count), 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        yield slice(at, stop)
        at = stop
