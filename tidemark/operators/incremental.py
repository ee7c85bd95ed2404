"""Interval construction that an import changes only where it must.

What a bucket of events does to a state (build.py) is kept as a table. An import computes that anew for the keys' days that get
events, runs the states of those keys through the effects of all their buckets, and builds only the days whose events or entry
states changed; the events of other days are not read. Nothing is overwritten: each import is a version, a row of a key and day
counts if no later version has that key and day, and readers see an import when its last table is written.

    path/events    day, version     new events
    path/effects   version          effects of the buckets of key-days with new events
    path/entries   version          entry states of the key-days that were built anew
    path/built     day, version     chunks and warnings of those
    path/versions                   a row for each version that is complete
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import build, merge

EVENTS = "tenant_id long, id long, timestamp timestamp_ntz, device_source string, event_kind string, category string, name string, revision long, day date, version long"
_KEY_DAY = ["tenant_id", "source", "day"]


@dataclass(frozen=True)
class Store:
    """Events and what is built from them, in a folder that all executors share. Equal events that differ in an expression of
    `apart` are no repeats (merge.new_events)."""

    spark: SparkSession
    path: str
    apart: tuple[str, ...] = ()

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("version") <= self.version())

    def create(self) -> Store:
        """An empty store; one that is there stays as it is."""
        for name, schema in (("events", EVENTS), ("effects", _EFFECTS), ("entries", _ENTRY), ("built", _BUILT), ("versions", "complete long")):
            folders = ["day"] if name in ("events", "built") else []
            self.spark.createDataFrame([], schema).drop("version").write.mode("ignore").partitionBy(*folders).parquet(f"{self.path}/{name}/version=0")
        return self

    def version(self) -> int:
        """The last complete import."""
        return self.spark.read.schema("complete long").parquet(f"{self.path}/versions").agg(F.max("complete")).first()[0] or 0

    def events(self) -> DataFrame:
        return self._table("events", EVENTS).drop("version")

    def built(self) -> DataFrame:
        """What build.build() gives for all events."""
        return _current(self._table("built", _BUILT), self._table("entries", _ENTRY)).select(_OUT)

    def add(self, incoming: DataFrame) -> DataFrame:
        """Import events: those that the store has not, once each. Returns the key-days that were built anew."""
        version = self.version() + 1
        dated = incoming.withColumn("day", F.to_date("timestamp"))
        days = _days(dated)
        fresh = merge.new_events(dated, self.events().filter(F.col("day").isin(days)), self.apart)
        self._append(fresh.select([c for c in self.events().columns]), "events", version)
        added = self._read("events", EVENTS, version)
        touched = build.bucket_rows(added).select(_KEY_DAY).distinct()
        # effects of the touched key-days, from their events alone
        self._append(build.effects_of(build.buckets(self._rows(touched, version))), "effects", version)
        old_effects = self._table("effects", _EFFECTS)
        effects = _current(old_effects.unionByName(self._read("effects", _EFFECTS, version).withColumn("version", F.lit(version).cast("long"))))
        keys = touched.select("tenant_id", "source").distinct()
        entry = build.entries(_semi(effects, keys, ["tenant_id", "source"]).drop("version"))
        before = _current(self._table("entries", _ENTRY)).drop("version")
        self._append(_changed(entry, before, touched), "entries", version)
        entered = self._read("entries", _ENTRY, version)
        anew = entered.select(_KEY_DAY).distinct()
        self._append(build.results(build.buckets(self._rows(anew, version)), entered.drop("version")), "built", version, "day")
        self.spark.range(1).select(F.lit(version).cast("long").alias("complete")).write.mode("overwrite").parquet(f"{self.path}/versions/version={version}")
        return anew

    def _append(self, df: DataFrame, name: str, version: int, *folders: str) -> None:
        """A table of one version; one that a failed import left behind is replaced."""
        folders = folders or (("day",) if name == "events" else ())
        df = df.hint("rebalance", *folders) if folders else df  # files of a day follow its size
        df.drop("version").write.mode("overwrite").partitionBy(*folders).parquet(f"{self.path}/{name}/version={version}")

    def _read(self, name: str, schema: str, version: int) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}/version={version}")

    def _rows(self, key_days: DataFrame, version: int) -> DataFrame:
        """Start and end events of some key-days: only files of their days are read."""
        events = self.spark.read.schema(EVENTS).parquet(f"{self.path}/events").filter((F.col("version") <= version) & F.col("day").isin(_days(key_days)))
        return _semi(build.bucket_rows(events), key_days, _KEY_DAY)


_STATE = "struct<id: bigint, ts: timestamp_ntz, category: string, name: string>"
_EFFECTS = f"tenant_id long, source string, day date, part int, idle {_STATE}, labels array<struct<category: string, name: string>>, after array<{_STATE}>, version long"
_ENTRY = f"tenant_id long, source string, day date, part int, entry {_STATE}, final boolean, version long"
_BUILT = f"{build.OUT}, day date, version long"
_OUT = [c.split()[0] for c in build.OUT.split(", ")]


def _days(df: DataFrame) -> list[date]:
    """The distinct days of a table: some thousands at most, whatever its size."""
    return [r.day for r in df.select("day").distinct().collect()]


def _semi(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    named = keys.select([F.col(c).alias(f"_{c}") for c in columns])
    return df.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left_semi")


def _current(rows: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Rows of the last version of their key and day (as `versions` has them)."""
    last = (rows if versions is None else versions).groupBy(*[F.col(c).alias(f"_{c}") for c in _KEY_DAY]).agg(F.max("version").alias("_version"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KEY_DAY]
    return rows.join(last, [*same, F.col("version") == F.col("_version")], "left_semi")


def _changed(entry: DataFrame, before: DataFrame, touched: DataFrame) -> DataFrame:
    """All entries of the key-days that were touched, or of which an entry is another one than before."""
    old = before.select(*[F.col(c).alias(f"_{c}") for c in (*_KEY_DAY, "part")], F.struct("entry", "final").alias("_old"))
    joined = entry.join(old, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*_KEY_DAY, "part")], "left")
    other = joined.filter(~F.struct("entry", "final").eqNullSafe(F.col("_old"))).select(_KEY_DAY)
    return _semi(entry, other.unionByName(touched).distinct(), _KEY_DAY)
