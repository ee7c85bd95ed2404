"""The filter builder: an immutable set of conditions that becomes column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .carry import numbered

#: Names of the presets.
PRESETS = ("Today", "Yesterday", "Last 7 days", "Last 30 days", "This week", "Last week", "This month", "Last month", "This year", "Last year", "All time")


def midnight(day: date | str) -> datetime:
    return datetime.combine(date.fromisoformat(day) if isinstance(day, str) else day, time())


def _next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def _names(value: str | Iterable[str] | None) -> tuple[str, ...]:
    return () if value is None else (value,) if isinstance(value, str) else tuple(value)


@dataclass(frozen=True)
class TimelineQuery:
    """Half-open time range, sets of names (an empty set filters nothing), duration bounds, weekday and search."""

    start: datetime | None = None
    end: datetime | None = None
    categories: tuple[str, ...] = ()
    activities: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    min_seconds: int | None = None
    max_seconds: int | None = None
    weekday_is: int | None = None
    search_for: str | None = None

    def between(self, start: datetime | date | None, end: datetime | date | None) -> TimelineQuery:
        exact = lambda x: x if x is None or isinstance(x, datetime) else midnight(x)
        return replace(self, start=exact(start), end=exact(end))

    def before(self, end):
        return self.between(self.start, end)

    def after(self, start):
        return self.between(start, self.end)

    def day(self, day: date | str) -> TimelineQuery:
        first = midnight(day)
        return self.between(first, first + timedelta(days=1))

    def week(self, year: int | str, number: int | None = None) -> TimelineQuery:
        """ISO week, as week(2026, 31) or week("2026-31")."""
        if number is None:
            year, number = map(int, re.fullmatch(r"(\d{4})-W?(\d{1,2})", str(year)).groups())
        first = midnight(date.fromisocalendar(int(year), number, 1))
        return self.between(first, first + timedelta(days=7))

    def month(self, year: int | str, number: int | None = None) -> TimelineQuery:
        if number is None:
            year, number = map(int, re.fullmatch(r"(\d{4})-(\d{1,2})", str(year)).groups())
        first = date(int(year), number, 1)
        return self.between(first, _next_month(first))

    def year(self, year: int | str) -> TimelineQuery:
        return self.between(date(int(year), 1, 1), date(int(year) + 1, 1, 1))

    def last(self, *, days: int, now: datetime) -> TimelineQuery:
        if days <= 0:
            raise ValueError("days must be positive")
        return self.between(now - timedelta(days=days), now)

    def category(self, value):
        return replace(self, categories=_names(value))

    def activity(self, value):
        return replace(self, activities=_names(value))

    def source(self, value):
        return replace(self, sources=_names(value))

    def duration(self, *, minimum: int | None = None, maximum: int | None = None) -> TimelineQuery:
        return replace(self, min_seconds=minimum, max_seconds=maximum)

    def weekday(self, number: int) -> TimelineQuery:
        """Monday is 0."""
        if not 0 <= number <= 6:
            raise ValueError("weekday is 0 to 6")
        return replace(self, weekday_is=number)

    def search(self, text: str | None) -> TimelineQuery:
        """Substring of name or category; % and _ are wildcards."""
        return replace(self, search_for=text)

    def _labels(self, columns: Iterable[str], source: str) -> list[Column]:
        found = []
        for name, values in (("category", self.categories), ("name", self.activities), (source, self.sources)):
            if values:
                if name not in columns:
                    raise ValueError(f"the table has no column {name}")
                found.append(F.col(name).isin(*values))
        if self.search_for:
            pattern = "%" + self.search_for.replace("\\", "\\\\") + "%"
            found.append(F.col("name").ilike(pattern) | F.col("category").ilike(pattern))
        return found

    def _durations(self, columns: Iterable[str]) -> list[Column]:
        if (self.min_seconds is not None or self.max_seconds is not None) and "duration_seconds" not in columns:
            raise ValueError("the table has no column duration_seconds")
        found = []
        if self.min_seconds is not None:
            found.append(F.col("duration_seconds") >= self.min_seconds)
        if self.max_seconds is not None:
            found.append(F.col("duration_seconds") <= self.max_seconds)
        return found

    def rows(self, df: DataFrame, *, time_column: str = "timestamp", source: str = "device_source") -> DataFrame:
        """Rows whose instant lies in the range (events, points, annotations, context; chunks by their start)."""
        found = [*self._labels(df.columns, source), *self._durations(df.columns)]
        t = F.col(time_column)
        found += [t >= F.lit(self.start).cast("timestamp_ntz")] if self.start else []
        found += [t < F.lit(self.end).cast("timestamp_ntz")] if self.end else []
        found += [F.weekday(t) == self.weekday_is] if self.weekday_is is not None else []
        return _all(df, found)

    def persisted(self, chunks: DataFrame) -> DataFrame:
        """Untouched chunks that start in the range."""
        return self.rows(chunks, time_column="start_timestamp", source="source")

    def clipped(self, chunks: DataFrame) -> DataFrame:
        """Chunks that overlap the range, cut to it; the duration bounds see the cut duration."""
        from .intervals import clip

        found = self._labels(chunks.columns, "source")
        found += [F.weekday("start_timestamp") == self.weekday_is] if self.weekday_is is not None else []
        cut = clip(_all(chunks, found), self.start, self.end)
        return _all(cut, self._durations(cut.columns))


def _all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def preset_range(name: str, today: date) -> tuple[datetime | None, datetime | None]:
    """Half-open range of a named preset; ranges of the running week, month and year end tomorrow."""
    day, monday, first, new_year = timedelta(days=1), today - timedelta(days=today.weekday()), today.replace(day=1), date(today.year, 1, 1)
    last_first = (first - day).replace(day=1)
    bounds = {
        "Today": (today, today + day),
        "Yesterday": (today - day, today),
        "Last 7 days": (today - 6 * day, today + day),
        "Last 30 days": (today - 29 * day, today + day),
        "This week": (monday, today + day),
        "Last week": (monday - 7 * day, monday),
        "This month": (first, today + day),
        "Last month": (last_first, first),
        "This year": (new_year, today + day),
        "Last year": (date(today.year - 1, 1, 1), new_year),
        "All time": (None, None),
    }[name]
    return tuple(None if x is None else midnight(x) for x in bounds)


def custom_range(first: date, last: date) -> tuple[datetime, datetime]:
    """The last day is part of the range."""
    return midnight(first), midnight(last) + timedelta(days=1)


def previous_range(start: datetime | None, end: datetime | None) -> tuple[datetime | None, datetime | None]:
    """The range of the same length just before; a range without both bounds has none."""
    if start is None or end is None:
        return None, None
    if end <= start:
        raise ValueError("end must be after start")
    return start - (end - start), start


def event_search(events: DataFrame, needle: str) -> DataFrame:
    text = F.concat_ws("\u0001", F.col("id").cast("string"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "device_source", "event_kind", "category", "name")
    return events.filter(F.contains(F.lower(text), F.lit(needle.lower())))


def metadata_distinct(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.select("tenant_id", F.col(column).alias("value")).filter("value is not null").distinct()


def date_range(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tenant_id").agg(F.min("start_timestamp").alias("first_start"), F.max("end_timestamp").alias("last_end"))


def activity_tree(chunks: DataFrame, needle: str | None = None) -> DataFrame:
    """Sorted distinct names of each category, of all or of those that the needle is part of."""
    pairs = chunks.select("tenant_id", "category", "name").distinct()
    if needle:
        low = F.lit(needle.lower())
        pairs = pairs.filter(F.contains(F.lower(F.coalesce("name", F.lit(""))), low) | F.contains(F.lower(F.coalesce("category", F.lit(""))), low))
    return pairs.groupBy("tenant_id", "category").agg(F.array_sort(F.collect_list("name")).alias("names"))


def chunk_by_event_ids(selections: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each selection (selection_id, tenant_id, ids): chunks whose two events hold all of its ids."""
    one = selections.withColumn("any_id", F.element_at("ids", 1))
    ends = chunks.select("tenant_id", F.col("id").alias("chunk_id"), "start_event_id", "end_event_id", F.explode(F.array_distinct(F.array("start_event_id", "end_event_id"))).alias("any_id"))
    return one.join(ends, ["tenant_id", "any_id"]).filter(F.forall("ids", lambda x: (x == F.col("start_event_id")) | (x == F.col("end_event_id")))).select("selection_id", "tenant_id", "chunk_id")


def events_of_chunks(chunks: DataFrame, events: DataFrame) -> DataFrame:
    ends = chunks.select("tenant_id", F.col("id").alias("chunk_id"), F.explode(F.array("start_event_id", "end_event_id")).alias("id"))
    return ends.join(events, ["tenant_id", "id"])


def duration_threshold_sweep(chunks: DataFrame, thresholds: list[int]) -> DataFrame:
    counts = chunks.agg(*[F.coalesce(F.sum(F.when(F.col("duration_seconds") >= t, 1).otherwise(0)), F.lit(0)).alias(str(t)) for t in thresholds])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(str(t)).alias("chunks")) for t in thresholds])).alias("x")).select("x.*")


def rows_around(log: DataFrame, targets: DataFrame, before: int, after: int) -> DataFrame:
    """Rows within some positions of the target rows (tenant_id, seq), each once. Positions follow (ts, seq)."""
    placed = numbered(log, ["tenant_id"], ["ts", "seq"], "position")
    at = placed.join(targets, ["tenant_id", "seq"], "left_semi").select("tenant_id", F.explode(F.sequence(F.col("position") - before, F.col("position") + after)).alias("position"))
    return placed.join(at.distinct(), ["tenant_id", "position"], "left_semi").drop("position")
