"""Chunk tables with a current version.

A write puts its files into a folder of its own and then appends one row to the table's manifest: version, folder, longest chunk,
and rows, first start and last end of each start date. That row is one file, and Spark's commit of it is one rename, so a reader
sees the old version or the new one and never a part. Scans choose start dates by the manifest: a chunk that reaches into a range
starts no earlier than the longest chunk before it, and on a date of which some chunk does.

One writer at a time: two that start from one version both write the next, and the later row wins.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType

from ..operators.filters import TimelineQuery
from .shared import delete

_MANIFEST = "version long, written timestamp, folder string, longest_seconds long, dates array<struct<start_date: date, n: long, first_start: timestamp_ntz, last_end: timestamp_ntz>>, schema string"


@dataclass(frozen=True)
class VersionedTable:
    """Chunks (start_timestamp and end_timestamp are needed) under a folder that all executors share."""

    spark: SparkSession
    path: str

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")

    def create(self) -> VersionedTable:
        self.spark.createDataFrame([], _MANIFEST).write.mode("ignore").parquet(f"{self.path}/manifest")
        return self

    def current(self, version: int | None = None) -> Row | None:
        """The manifest row of the last version, or of a given one; None if there is none."""
        rows = self.manifest() if version is None else self.manifest().filter(F.col("version") == version)
        return rows.orderBy(F.desc("version"), F.desc("written")).first()

    def write(self, chunks: DataFrame) -> int:
        """Full replacement: a new version, which readers get from the moment it is whole."""
        before = self.current()
        version = before.version + 1 if before else 1
        folder = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        dated = chunks.withColumn("start_date", F.to_date("start_timestamp"))
        dated.hint("rebalance", "start_date").sortWithinPartitions("start_date", "start_timestamp").write.partitionBy("start_date").parquet(folder)
        stored = self.spark.read.schema(dated.schema).parquet(folder)
        seconds = F.timestamp_diff("SECOND", F.col("start_timestamp"), F.col("end_timestamp"))
        by_date = stored.groupBy("start_date").agg(F.count("*").alias("n"), F.min("start_timestamp").alias("first_start"), F.max("end_timestamp").alias("last_end"), F.max(seconds).alias("longest"))
        row = by_date.agg(
            F.lit(version).cast("long").alias("version"),
            F.current_timestamp().alias("written"),
            F.lit(folder).alias("folder"),
            F.coalesce(F.max("longest"), F.lit(0).cast("long")).alias("longest_seconds"),
            F.array_sort(F.collect_list(F.struct("start_date", "n", "first_start", "last_end"))).alias("dates"),  # a row for each date
            F.lit(chunks.schema.json()).alias("schema"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """All chunks of the current version, or of a given one."""
        return self._files(self._row(version)).drop("start_date")

    def overlapping(self, start: datetime, end: datetime, version: int | None = None) -> DataFrame:
        """Chunks that share time with [start, end); only files of dates that have one are read."""
        row = self._row(version)
        dates = [d.start_date for d in row.dates if d.start_date and d.first_start < end and d.last_end and d.last_end > start]
        first = (start - timedelta(seconds=row.longest_seconds + 1)).date()
        on = F.col("start_date")
        rows = self._files(row).filter((on >= F.lit(first)) & (on <= F.lit(end.date())) & (on.isin(dates) if dates else F.lit(False)))
        return rows.filter((F.col("end_timestamp") > F.lit(start).cast("timestamp_ntz")) & (F.col("start_timestamp") < F.lit(end).cast("timestamp_ntz"))).drop("start_date")

    def clipped(self, query: TimelineQuery, version: int | None = None) -> DataFrame:
        """Chunks under a query, cut to its range."""
        known = query.start is not None and query.end is not None
        return query.clipped(self.overlapping(query.start, query.end, version) if known else self.read(version))

    def expire(self, keep: int = 2) -> list[int]:
        """Delete the files of all but the last versions; who still reads one of them fails. Returns their numbers."""
        rows = self.manifest().orderBy(F.desc("version"), F.desc("written")).collect()  # a row for each version
        for row in rows[keep:]:
            delete(self.spark, row.folder)
        return [row.version for row in rows[keep:]]

    def _row(self, version: int | None) -> Row:
        row = self.current(version)
        if row is None:
            raise LookupError(f"no version {version or ''} in {self.path}")
        return row

    def _files(self, row: Row) -> DataFrame:
        schema = StructType.fromJson(json.loads(row.schema)).add("start_date", DateType())
        return self.spark.read.schema(schema).parquet(row.folder)
