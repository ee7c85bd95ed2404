"""Neighbours and last known values in a key's time order, with the work of a hot key spread over its days.

Windows run inside (key, day), and what crosses a day's edge comes from one row a key and day. Keys are held without nulls
beside a column that says which ones were null: so the join with the edges is on plain columns and keeps the windows'
partitioning and order, and wide rows are shuffled and sorted once. Null keys and times are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

_FIRST = "0001-01-01"


def _bucketed(df: DataFrame, keys: list[str], time: str) -> tuple[DataFrame, list[str]]:
    """df with its keys and day without nulls, and the names of these columns, the day last."""
    names, nulls = [f"_key{i}" for i in range(len(keys))], F.lit(0)
    columns = {}
    for i, (name, key) in enumerate(zip(names, keys, strict=True)):
        kind = df.schema[key].dataType
        blank = F.lit("" if isinstance(kind, StringType) else 0 if isinstance(kind, (NumericType, BooleanType)) else _FIRST)
        columns[name] = F.coalesce(F.col(key), blank.cast(kind))
        nulls = nulls + F.when(F.col(key).isNull(), 1 << i).otherwise(0)
    columns |= {"_nulls": nulls, "_day": F.coalesce(F.to_date(time), F.lit(_FIRST).cast("date"))}
    return df.withColumns(columns), [*names, "_nulls", "_day"]


def _days(bucket: list[str]) -> Window:
    return Window.partitionBy(*bucket[:-1]).orderBy(bucket[-1])


def neighbour(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], *, ahead: bool = False) -> DataFrame:
    """df with columns of the row before (or after) each row, under new names ({name: column}); null without one.
    order begins with the time column."""
    df, bucket = _bucketed(df, keys, order[0])
    row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    step = F.lead if ahead else F.lag
    edge = (F.min_by if ahead else F.max_by)(row, F.struct(*order))
    edges = df.groupBy(*bucket).agg(edge.alias("_edge")).withColumn("_edge", step("_edge").over(_days(bucket)))
    near = df.withColumn("_near", step(row).over(Window.partitionBy(*bucket).orderBy(*order)))
    out = near.join(edges, bucket, "left").withColumn("_near", F.coalesce("_near", "_edge"))
    return out.withColumns({n: F.col(f"_near.{n}") for n in columns}).drop("_near", "_edge", *bucket)


def last_known(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], *, before: str | None = None) -> DataFrame:
    """df with the last value that is not null of each expression, up to and with each row; with a prefix in `before` also
    the last one of the rows before it."""
    df, bucket = _bucketed(df, keys, order[0])
    df = df.withColumns({f"_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*bucket).orderBy(*order)
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    days = _days(bucket).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy(*bucket).agg(*[F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.struct(*order))).alias(f"_edge_{n}") for n in values])
    edges = edges.select(*bucket, *[F.last(f"_edge_{n}", ignorenulls=True).over(days).alias(f"_edge_{n}") for n in values])
    frames = {n: (n, upto) for n in values} | ({f"{before}{n}": (n, earlier) for n in values} if before else {})
    out = df.withColumns({name: F.last(f"_{n}", ignorenulls=True).over(frame) for name, (n, frame) in frames.items()}).join(edges, bucket, "left")
    return out.withColumns({name: F.coalesce(name, f"_edge_{n}") for name, (n, _) in frames.items()}).drop(*bucket, *[f"_{n}" for n in values], *[f"_edge_{n}" for n in values])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with each row's position in its key's order, from 1: rows of the days before, and the position in the day."""
    df, bucket = _bucketed(df, keys, order[0])
    before = F.sum("_edge").over(_days(bucket).rowsBetween(Window.unboundedPreceding, -1))
    edges = df.groupBy(*bucket).agg(F.count("*").alias("_edge")).select(*bucket, F.coalesce(before, F.lit(0)).alias("_edge"))
    inside = df.withColumn("_near", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order)))
    return inside.join(edges, bucket, "left").withColumn(name, F.col("_edge") + F.col("_near")).drop("_edge", "_near", *bucket)
