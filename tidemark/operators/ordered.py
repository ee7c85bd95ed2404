"""Appending one ordered log to another: what the end of the one and the beginning of the other share comes once.

The overlap is the largest k for which the master's last k rows are the incoming log's first k. Rows get polynomial hashes,
whose running sums are made in blocks of rows; a running sum of the incoming log at k and one of the master at its k-th row from
the end then say whether the k rows may be equal. The largest such k is checked row by row, and the next one if it was none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

#: Rows of one block of running sums.
BLOCK = 100_000
_BASE, _BITS = 0xD1342543DE82EF95, (1 << 64) - 1


def _powers(first: int, n: int) -> np.ndarray:
    """Powers of the base from `first` on, modulo 2 ** 64."""
    steps = np.full(n, _BASE, np.uint64)
    steps[:1] = pow(_BASE, first, 1 << 64)
    return np.multiply.accumulate(steps)


def _running(rows: DataFrame, columns: list[str], seq: str, block: int) -> DataFrame:
    """seq, block, inside: sums of hash times base ^ seq from the block's first row to each row."""
    hashed = rows.select(F.col(seq).cast("long").alias("seq"), F.expr(f"(`{seq}` - 1) div {block}").alias("block"), F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("hash"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, np.uint64(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sums = np.cumsum(batch.column(2).to_numpy().view(np.uint64) * _powers(int(at[0]), len(at)) if _dense(at) else _products(at, batch.column(2).to_numpy()), dtype=np.uint64)
            starts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1])
            before = np.concatenate([[np.uint64(0)], sums])[starts]  # what the batch had summed up before each of its blocks
            if of[0] == last:
                before[0] = (np.zeros(1, np.uint64) - carry)[0]
            inside = sums - np.repeat(before, np.diff(np.append(starts, len(of))))
            last, carry = of[-1], inside[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(inside.view(np.int64))], ["seq", "block", "inside"])

    return hashed.repartition("block").sortWithinPartitions("block", "seq").mapInArrow(add, "seq long, block long, inside long")


def _dense(at: np.ndarray) -> bool:
    return int(at[-1]) - int(at[0]) == len(at) - 1


def _products(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Terms of rows from more than one block."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]])
    powers = np.concatenate([_powers(int(at[a]), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return hashes.view(np.uint64) * powers


def _sums(rows: DataFrame, columns: list[str], seq: str, block: int, tag: str) -> tuple[DataFrame, DataFrame]:
    """Stored running sums, and the halves of the sums of all blocks before each block."""
    running = materialize(_running(rows, columns, seq, block), tag)
    total = running.groupBy("block").agg(F.max_by("inside", "seq").alias("total"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    low, high = F.col("total").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("total", 32)
    return running, total.select("block", F.coalesce(F.sum(low).over(before), F.lit(0)).alias("low"), F.coalesce(F.sum(high).over(before), F.lit(0)).alias("high"))


def candidates(master: DataFrame, incoming: DataFrame, columns: list[str], seq: str, n: int, block: int = BLOCK) -> DataFrame:
    """k: lengths of the overlap for which the hashes agree."""
    old, old_blocks = _sums(master, columns, seq, block, "master-sums")
    new, new_blocks = _sums(incoming, columns, seq, block, "incoming-sums")
    end = old.join(old_blocks, "block").filter(F.col("seq") == n).select("inside", "low", "high").first()
    whole = _total(*end) if end else 0
    # the master's sum up to the row before its last k; there is none for k = n
    first = old.join(old_blocks, "block").select((F.lit(n) - F.col("seq")).alias("k"), F.col("inside").alias("old_inside"), F.col("low").alias("old_low"), F.col("high").alias("old_high"))
    first = first.filter("k > 0").unionByName(old.sparkSession.range(1).select(F.lit(n).cast("long").alias("k"), *[F.lit(0).cast("long").alias(f"old_{c}") for c in ("inside", "low", "high")]))
    both = new.join(new_blocks, "block").withColumnRenamed("seq", "k").join(first, "k").select("k", "inside", "low", "high", "old_inside", "old_low", "old_high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, *columns = (c.to_numpy().view(np.uint64) for c in batch.columns)
            new_sum, old_sum = (a + b + (c << np.uint64(32)) for a, b, c in (columns[:3], columns[3:]))
            shift = _power_of(np.uint64(n) - k)
            same = new_sum * shift == np.full(len(k), whole & _BITS, np.uint64) - old_sum
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)[same])], ["k"])

    return both.mapInArrow(compare, "k long")


def _total(inside: int, low: int, high: int) -> int:
    return (inside + low + (high << 32)) & _BITS


def _power_of(exponents: np.ndarray) -> np.ndarray:
    """Powers of the base, modulo 2 ** 64, by squaring."""
    out, square = np.ones(len(exponents), np.uint64), _BASE
    left = exponents.copy()
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        square, left = square * square & _BITS, left >> np.uint64(1)
    return out


def overlap(master: DataFrame, incoming: DataFrame, *, seq: str = "seq", block: int = BLOCK) -> int:
    """The largest k for which the last k rows of master equal the first k of incoming in all columns but seq; nulls are equal.
    seq numbers the rows of each from 1 without a gap."""
    columns = [c for c in incoming.columns if c != seq]
    n = master.agg(F.max(seq)).first()[0]
    if not n:
        return 0
    found = materialize(candidates(master, incoming, columns, seq, n, block), "overlaps")
    limit = F.lit(True)
    try:
        while (k := found.filter(limit).agg(F.max("k")).first()[0]) is not None:
            row = lambda df, at, name: df.select(at.alias("at"), F.struct(*columns).alias(name))
            ends = row(master.filter(F.col(seq) > n - k), F.col(seq) - (n - k), "old")
            starts = row(incoming.filter(F.col(seq) <= k), F.col(seq), "new")
            if ends.join(starts, "at", "full").filter(~F.col("old").eqNullSafe(F.col("new"))).isEmpty():
                return k
            limit = F.col("k") < k
        return 0
    finally:
        discard(found)


def append_ordered(master: DataFrame, incoming: DataFrame, *, seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """Incoming rows that follow the overlap, numbered on from the master's last row."""
    k = overlap(master, incoming, seq=seq, block=block)
    n = master.agg(F.coalesce(F.max(seq), F.lit(0))).first()[0]
    return incoming.filter(F.col(seq) > k).withColumn(seq, F.col(seq) - k + n)
