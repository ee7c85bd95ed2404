"""A timeline as an immutable query over lazy tables: filters give new timelines, results are DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date
from functools import partial
from inspect import isfunction
from types import ModuleType

from pyspark.sql import DataFrame

from ..operators import days, filters, intervals, stats
from ..operators.filters import TimelineQuery


@dataclass(frozen=True)
class Timeline:
    """chunks(), clipped() and events() follow the filters; statistics use the clipped view."""

    chunk_table: DataFrame
    event_table: DataFrame | None = None
    query: TimelineQuery = field(default_factory=TimelineQuery)
    point_table: DataFrame | None = None
    annotation_table: DataFrame | None = None
    context_table: DataFrame | None = None
    marker_table: DataFrame | None = None

    def __getattr__(self, name: str):
        method = getattr(TimelineQuery, name, None)
        if name.startswith("_") or method is None:
            raise AttributeError(name)
        return lambda *args, **kwargs: replace(self, query=method(self.query, *args, **kwargs))

    def chunks(self) -> DataFrame:
        return self.query.persisted(self.chunk_table)

    def clipped(self) -> DataFrame:
        return self.query.clipped(self.chunk_table)

    def _rows(self, table: DataFrame | None, what: str, **columns: str) -> DataFrame:
        if table is None:
            raise ValueError(f"this timeline has no {what}")
        return self.query.rows(table, **columns)

    def events(self) -> DataFrame:
        return self._rows(self.event_table, "events")

    def points(self) -> DataFrame:
        return self._rows(self.point_table, "points", source="source")

    def annotations(self) -> DataFrame:
        """Annotations have only a time: other conditions than the range don't apply to them."""
        if self.annotation_table is None:
            raise ValueError("this timeline has no annotations")
        return TimelineQuery(start=self.query.start, end=self.query.end, weekday_is=self.query.weekday_is).rows(self.annotation_table)

    def context(self) -> DataFrame:
        return self._rows(self.context_table, "context", source="source")

    def day_markers(self) -> DataFrame:
        """Typed markers of the days in the range."""
        if self.marker_table is None:
            raise ValueError("this timeline has no markers")
        return TimelineQuery(start=self.query.start, end=self.query.end, weekday_is=self.query.weekday_is).rows(days.typed_markers(self.marker_table), time_column="day")

    def day_marker(self, day: date | str) -> DataFrame:
        return replace(self, query=TimelineQuery().day(day)).day_markers()

    def day_picture(self, day: date | str, sleep: str = "Sleep") -> DataFrame:
        """The picture of one day of all tenants, whatever the other conditions are."""
        one = TimelineQuery().day(day)
        markers = None if self.marker_table is None else self.day_marker(day)
        return days.day_picture(one.clipped(self.chunk_table), sleep, markers)

    @property
    def statistics(self) -> Bound:
        """Statistics of the clipped chunks: scalar_stats, summary, by_activity, by_category, by_day, daily_average, ..."""
        return Bound(stats, self.clipped)

    @property
    def analytics(self) -> Bound:
        """summarize, over_time, share, pivot, rolling, transitions, describe, ... of the clipped chunks."""
        return Bound(stats, self.clipped)

    @property
    def metadata(self) -> Bound:
        """metadata_distinct, date_range and activity_tree of the whole table."""
        return Bound(filters, lambda: self.chunk_table)

    def intersect(self, names: list[str], screens: DataFrame) -> DataFrame:
        """Time of the named activities inside the screens, by the scope rule."""
        return intervals.intersect(intervals.scoped(self.chunk_table, self.query, names), screens)

    def compare(self, other: Timeline, by: list[str], **kwargs) -> DataFrame:
        return stats.compare(self.clipped(), other.clipped(), by, **kwargs)

    def by_activity(self) -> DataFrame:
        return self.statistics.by_activity()

    def over_time(self, period: str, **kwargs) -> DataFrame:
        return self.analytics.over_time(period, **kwargs)

    def rolling(self, period: str, window: int, **kwargs) -> DataFrame:
        return self.analytics.rolling(period, window, **kwargs)

    def transitions(self, by: list[str], **kwargs) -> DataFrame:
        return self.analytics.transitions(by, **kwargs)

    def date_range(self) -> DataFrame:
        return self.metadata.date_range()


@dataclass(frozen=True)
class Bound:
    """The functions of a module with a table as their first argument."""

    module: ModuleType
    table: Callable[[], DataFrame]

    def __getattr__(self, name: str):
        f = None if name.startswith("_") else getattr(self.module, name, None)
        if not isfunction(f) or f.__module__ != self.module.__name__:
            raise AttributeError(name)
        return partial(f, self.table())
