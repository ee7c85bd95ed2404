"""Text forms of durations, periods and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units of a duration in words.
UNITS = (("d", 86400, None), ("h", 3600, 24), ("m", 60, 60), ("s", 1, 60))


def human_duration(seconds: Column) -> Column:
    """`1d 2h 3m 4s` without zero parts, `0s` for nothing, a dash for null or non-finite values; halves go to even."""
    value = seconds.cast("double")
    whole = F.bround(F.abs(value)).cast("long")
    parts = [F.when(part > 0, F.concat(part.cast("string"), F.lit(unit))) for unit, part in ((u, _part(whole, size, cycle)) for u, size, cycle in UNITS)]
    text = F.concat_ws(" ", *parts)
    sign = F.when((value < 0) & (whole > 0), F.lit("-")).otherwise(F.lit(""))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, F.concat(sign, F.when(text == "", "0s").otherwise(text))).otherwise("—")


def _part(whole: Column, size: int, cycle: int | None) -> Column:
    part = F.floor(whole / size)
    return (part if cycle is None else part % cycle).cast("long")


def text_duration(seconds: Column) -> Column:
    """`1 hour 30 minutes`; `0 minutes` for less than a minute, null and negative values count as zero."""
    whole = F.greatest(F.coalesce(seconds, F.lit(0)).cast("long"), F.lit(0))
    hours, minutes = F.floor(whole / 3600), F.floor(whole / 60) % 60
    plural = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))
    text = F.concat_ws(" ", F.when(hours > 0, plural(hours, "hour")), F.when(minutes > 0, plural(minutes, "minute")))
    return F.when(text == "", "0 minutes").otherwise(text)


def clock_duration(seconds: Column, *, with_seconds: bool = False) -> Column:
    """`H:MM`, or `H:MM:SS`."""
    whole = seconds.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = [F.floor(whole / 3600).cast("string"), two(F.floor(whole / 60) % 60)]
    return F.concat_ws(":", *parts, *([two(whole % 60)] if with_seconds else []))


def iso_week(day: Column) -> Column:
    """`YYYY-Www` of the ISO calendar."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def period_label(start: Column, unit: str) -> Column:
    if unit == "week":
        return iso_week(start)
    return F.date_format(start, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:mm"}[unit])


def percent_change(current: Column, previous: Column) -> Column:
    """Signed change in percent with one decimal; from zero it is +0.0% or +100.0%."""
    change = F.when(previous == 0, F.when(current == 0, 0.0).otherwise(100.0)).otherwise((current - previous) * 100.0 / previous)
    return F.format_string("%+.1f%%", change.cast("double"))


def activity_label(category: Column, name: Column, *, separator: str = " · ", name_first: bool = True) -> Column:
    """`name · category` or `category / name`; missing parts are left out."""
    parts = (name, category) if name_first else (category, name)
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def parse_people(text: Column) -> Column:
    """Names parted by commas or line feeds: trimmed, blanks dropped, first occurrences kept."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,\n]"), lambda x: F.trim(x)), lambda x: x != ""))


def parse_mood(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def parse_timestamp(text: Column) -> Column:
    """Clock reading of an ISO timestamp; an offset is dropped, what can't be read is null."""
    return text.try_cast("timestamp_ntz")


def split_task(task: Column) -> tuple[Column, Column]:
    """Category and name of `Category: Name`; without a colon the category is null."""
    colon = F.instr(task, ":")
    category = F.when(colon > 0, F.nullif(F.trim(F.substring(task, F.lit(1), colon - 1)), F.lit("")))
    name = F.when(colon > 0, F.trim(F.substr(task, colon + 1))).otherwise(F.trim(task))
    return category, name


def colour_index(label: Column, colours: int = 6) -> Column:
    """A colour number that depends on the label alone."""
    return F.conv(F.substring(F.sha1(F.coalesce(label, F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int") % colours


def seconds_into_day(ts: Column, day: Column) -> Column:
    """Seconds from the day's midnight, held between 0 and 86400."""
    seconds = F.expr("0") + F.timestamp_diff("SECOND", day.cast("timestamp_ntz"), ts)
    return F.least(F.greatest(seconds, F.lit(0)), F.lit(86400)).cast("long")
