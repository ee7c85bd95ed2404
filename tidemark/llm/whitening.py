"""Embedding whitening from exact integer moments.

Each entry c of a vector becomes the whole number floor(1024 c) + 100000. Their cross-products come from bit-sliced scatter:
entries are shifted by their dimension's minimum, each bit plane of a dimension is packed across rows into 64-bit words, and the
set bits of two planes' AND, weighted by the planes' powers of two, add up to the product exactly. The covariance is centred in
whole numbers and turned to doubles last, before its eigenvectors.

Vectors that are null, or hold null or non-finite entries, are dropped; so are vectors of another length than the most frequent
one (the smallest of equally frequent ones), as they have no place among the others. Repeated rows count each. Entries beyond
2^52 in size count as that, so that their numbers are whole longs. Components whose eigenvalue is zero to double precision can't
be scaled and are left out, so a table without vectors, with one vector or with equal vectors gives no rows. Deviations that no
long holds are null. Only the named columns are read; the id may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
_LARGEST = float(1 << 52)
#: Rows whose bit planes are packed at once.
BLOCK = 16_384
#: Sums leave a task as digits of 32 bits, so that no total of them overflows.
_DIGITS = 5


@dataclass(frozen=True)
class Whitening:
    """Row count, sums and least numbers of each dimension (exact), covariance, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


def usable(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and x, the vectors in whole numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    doubles = F.transform(vector, lambda c: c.cast("double"))
    kept = df.select(*keep, doubles.alias("x")).filter(F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(finite(c), F.lit(False))))
    whole = F.transform("x", lambda c: F.floor(F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST)) * SCALE) + OFFSET)
    length = kept.groupBy(F.size("x").alias("length")).count().filter("length > 0").orderBy(F.desc("count"), "length").first()
    return kept.filter(F.size("x") == (length.length if length else -1)).select(*keep, whole.alias("x"))


def _numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _digits(value: int) -> list[int]:
    """A number in _DIGITS digits of 32 bits, the last one with the sign."""
    return [value >> 32 * k & 0xFFFFFFFF for k in range(_DIGITS - 1)] + [value >> 32 * (_DIGITS - 1)]


def _whole(digits: tuple[int, ...]) -> int:
    return sum(d << 32 * k for k, d in enumerate(digits))


_DIGIT_COLUMNS = [f"d{k}" for k in range(_DIGITS)]


def _digit_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _DIGIT_COLUMNS]


def _ranges(x: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Row count, and each dimension's sum, least and largest number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _numbers(batch.column(0))
            sums = [(int(high) << 32) + int(low) for high, low in zip((rows >> 32).sum(axis=0), (rows & 0xFFFFFFFF).sum(axis=0), strict=True)]
            digits = list(zip(*map(_digits, sums), strict=True))
            columns = [np.arange(rows.shape[1]), np.full(rows.shape[1], len(rows)), rows.min(axis=0), rows.max(axis=0), *digits]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dimension", "n", "least", "most", *_DIGIT_COLUMNS])

    schema = ", ".join(f"{c} long" for c in ("dimension", "n", "least", "most", *_DIGIT_COLUMNS))
    found = x.select("x").mapInArrow(scan, schema).groupBy("dimension").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), *_digit_sums())
    rows = sorted(found.collect())  # one for each dimension
    return (rows[0].n if rows else 0), [_whole(r[4:]) for r in rows], [r.least for r in rows], [r.most for r in rows]


class Scatter:
    """Sums of products of shifted entries, from counts of rows in which two bits are set."""

    def __init__(self, least: list[int], most: list[int]):
        self.least = np.array(least, np.int64)
        bits = [int(b - a).bit_length() for a, b in zip(least, most, strict=True)]
        self.dimension = np.repeat(np.arange(len(bits)), bits)
        self.bit = np.concatenate([np.arange(b) for b in bits] or [np.empty(0, np.int64)])
        self.counts = np.zeros((len(bits), len(bits), max(1, 2 * max(bits, default=0))), np.int64)

    def add(self, rows: np.ndarray) -> None:
        shifted = np.zeros((-len(rows) % 64 + len(rows), rows.shape[1]), np.uint64)
        shifted[: len(rows)] = (rows - self.least).view(np.uint64)
        planes = np.empty((len(self.bit), len(shifted) // 64), np.uint64)
        for k, (d, b) in enumerate(zip(self.dimension.tolist(), self.bit.tolist(), strict=True)):
            planes[k] = np.packbits((shifted[:, d] >> np.uint64(b) & np.uint64(1)).astype(np.uint8)).view(np.uint64)
        for k, (d, b) in enumerate(zip(self.dimension.tolist(), self.bit.tolist(), strict=True)):
            both = np.bitwise_count(planes[k:] & planes[k]).sum(axis=1, dtype=np.int64)
            both[(self.dimension[k:] == d) & (self.bit[k:] != b)] *= 2  # two different bits of one dimension meet twice in its square
            self.counts[d, self.dimension[k:], self.bit[k:] + b] += both

    def totals(self) -> Iterator[tuple[int, int, int]]:
        """Two dimensions, the first not above the second, and the sum of their products."""
        n = len(self.least)
        for a in range(n):
            for b in range(a, n):
                yield a, b, sum(c << w for w, c in enumerate(self.counts[a, b].tolist()))


def _scatter(x: DataFrame, least: list[int], most: list[int]) -> np.ndarray:
    """Sums of products of all pairs of dimensions, as Python's whole numbers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = Scatter(least, most), []
        for batch in batches:
            if batch.num_rows:
                held.append(_numbers(batch.column(0)))
            if sum(map(len, held)) >= BLOCK:
                sums.add(np.concatenate(held))
                held = []
        if held:
            sums.add(np.concatenate(held))
        rows = [(a, b, *_digits(total)) for a, b, total in sums.totals()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", *_DIGIT_COLUMNS])

    schema = ", ".join(f"{c} long" for c in ("a", "b", *_DIGIT_COLUMNS))
    total = np.zeros((len(least), len(least)), object)
    for row in x.select("x").mapInArrow(scan, schema).groupBy("a", "b").agg(*_digit_sums()).collect():  # one for each pair of dimensions
        total[row.a, row.b] = total[row.b, row.a] = _whole(row[2:])
    return total


def fit(x: DataFrame) -> Whitening | None:
    """The whitening of the vectors of usable(); None if there are none."""
    n, sums, least, most = _ranges(x)
    if not n:
        return None
    shifted = np.array([s - n * a for s, a in zip(sums, least, strict=True)], object)
    centred = n * _scatter(x, least, most) - np.outer(shifted, shifted)
    covariance = (centred / (n * n)).astype(float)  # quotients of whole numbers, each rounded once
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    scaled = values > len(values) * np.finfo(float).eps * max(values[0], 0)
    components = vectors[:, scaled].T
    components *= np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])[:, None]
    return Whitening(n, sums, least, most, covariance, values[scaled], components, float(sum(centred.diagonal()) / (n * n)))


def _centred(rows: np.ndarray, model: Whitening) -> np.ndarray:
    """n x - S, exact: longs where they fit."""
    sums = [s - model.n * a for s, a in zip(model.sums, model.least, strict=True)]
    if model.n * max(b - a for a, b in zip(model.least, model.most, strict=True)) < 1 << 62:
        return (rows - np.array(model.least)) * model.n - np.array(sums)
    return (rows.astype(object) - np.array(model.least, object)) * model.n - np.array(sums, object)


def _squares(centred: np.ndarray) -> list[int | None]:
    """Sums of squares of rows; None beyond a long."""
    if centred.dtype != object and len(centred) and centred.shape[1] * int(np.abs(centred).max()) ** 2 < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    sums = [sum(int(c) ** 2 for c in row) for row in centred.tolist()]
    return [s if s < 1 << 63 else None for s in sums]


def _project(centred: np.ndarray, model: Whitening, top: int) -> np.ndarray:
    return centred.astype(float) / model.n @ model.components[:top].T / np.sqrt(model.values[:top])


def identity_error(x: DataFrame, model: Whitening, top: int) -> float:
    """How far the covariance of the whitened rows is from the identity, measured on the rows."""
    k = min(top, len(model.values))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                rows = _project(_centred(_numbers(batch.column(0)), model), model, k)
                products, sums = products + rows.T @ rows, sums + rows.sum(axis=0)
        a, b = (i.ravel() for i in np.indices((k, k + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.column_stack([products, sums]).ravel())], ["a", "b", "total"])

    total = np.zeros((k, k + 1))
    for row in x.select("x").mapInArrow(scan, "a long, b long, total double").groupBy("a", "b").agg(F.sum("total").alias("total")).collect():
        total[row.a, row.b] = row.total
    means = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(means, means) - np.eye(k)).max(initial=0))


def apply(x: DataFrame, model: Whitening, *, key: str, top: int = 8) -> DataFrame:
    """key, component, deviation, whitened, explained: a row for each vector and component."""
    k = min(top, len(model.values))
    explained = model.values[:k] / model.trace
    kind = x.schema[key].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            centred = _centred(_numbers(batch.column(1)), model)
            row = np.repeat(np.arange(n), k)
            columns = [
                batch.column(0).take(pa.array(row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(_squares(centred), pa.int64()).take(pa.array(row)),
                pa.array(_project(centred, model, k).ravel()),
                pa.array(np.tile(explained, n)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "deviation", "whitened", "explained"])

    return x.select(key, "x").mapInArrow(scan, f"`{key}` {kind.simpleString()}, component int, deviation long, whitened double, explained double")


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", top: int = 8) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error."""
    x = usable(df, vector, (key,))
    model = fit(x)
    if model is None or not len(model.values):
        schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(x, model, top)
    names = [key, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")]
    return apply(x, model, key=key, top=top).select(*names)
