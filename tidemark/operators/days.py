"""Per-day products for all tenants and days of a table in one job each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import colour_index, human_duration, iso_week, percent_change, seconds_into_day, text_duration
from ..sources.shared import materialize
from .intervals import intersect, split
from .stats import activity_day_comparison

_DAY = ["tenant_id", "day"]
_D = "duration_seconds"


def _is_screen() -> Column:
    return (F.col("source") == "phone") & (F.col("category") == "Screen") & (F.col("name") == "Screen on")


def screens(chunks: DataFrame) -> DataFrame:
    return chunks.filter(_is_screen())


def day_parts(chunks: DataFrame) -> DataFrame:
    return split(chunks, "day").withColumn("day", F.to_date("period")).drop("period")


def day_cells(chunks: DataFrame) -> DataFrame:
    """Sessions and seconds of each day, source and activity: what the other products of a day are made of."""
    return _cells(day_parts(chunks))


def _cells(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_DAY, "source", "category", "name").agg(F.count("*").alias("sessions"), F.sum(_D).alias(_D))


def _totals(sleep: str) -> list[Column]:
    """Tracked seconds of the embed source, screen seconds of the phone and seconds of the sleep activity."""
    embed = F.col("source") == "embed"
    asleep = embed & (F.lower("name") == sleep.lower())
    add = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col(_D)).otherwise(0))
    return [add(embed).alias("tracked_seconds"), add(_is_screen()).alias("screen_seconds"), add(asleep).alias("sleep_seconds")]


def day_totals(chunks: DataFrame, sleep: str) -> DataFrame:
    return day_cells(chunks).groupBy(*_DAY).agg(*_totals(sleep))


def _activities(cells: DataFrame) -> DataFrame:
    return cells.filter("source = 'embed' and name is not null").select(*_DAY, "category", "name", "sessions", F.col(_D).alias("total_seconds"))


def day_activities(chunks: DataFrame) -> DataFrame:
    return _activities(day_cells(chunks))


def _top(cells: DataFrame, sleep: str) -> DataFrame:
    """The activity with the most seconds, the first by name of equal ones."""
    names = _activities(cells).filter(F.lower("name") != sleep.lower()).groupBy(*_DAY, "name").agg(F.sum("total_seconds").alias("s"))
    return names.groupBy(*_DAY).agg(F.min(F.struct((-F.col("s")).alias("s"), "name")).alias("t")).select(*_DAY, F.col("t.name").alias("top_activity"), (-F.col("t.s")).alias("top_seconds"))


def top_of_day(chunks: DataFrame, sleep: str) -> DataFrame:
    return _top(day_cells(chunks), sleep)


def day_screen_overlap(chunks: DataFrame) -> DataFrame:
    """intersection of each day's embed activities with the phone's screen time."""
    return _overlap(day_parts(chunks))


def _overlap(parts: DataFrame) -> DataFrame:
    parts = parts.withColumnRenamed("day", "period")
    return intersect(parts.filter("source = 'embed'"), screens(parts), keys=("tenant_id", "period")).withColumnRenamed("period", "day")


def _whole_days(parts: DataFrame, sleep: str) -> DataFrame:
    """Totals, activities and top activity of each day in one pass: a day's cells, already sums, meet once."""
    cells = _cells(parts).repartition(*_DAY).withColumn("named", F.sum(_D).over(Window.partitionBy(*_DAY, "source", "name")))
    is_activity = (F.col("source") == "embed") & F.col("name").isNotNull()
    activity = F.when(is_activity, F.struct("category", "name", "sessions", F.col(_D).alias("total_seconds")))
    top = F.min(F.when(is_activity & (F.lower("name") != sleep.lower()), F.struct((-F.col("named")).alias("s"), "name")))
    days = cells.groupBy(*_DAY).agg(*_totals(sleep), F.sort_array(F.collect_list(activity)).alias("activities"), top.alias("top"))
    return days.withColumns({"top_activity": F.col("top.name"), "top_seconds": -F.col("top.s")}).drop("top")


def day_picture(chunks: DataFrame, sleep: str = "A0", markers: DataFrame | None = None) -> DataFrame:
    """One row a tenant and day, with activities and overlaps nested as arrays of structs, and the day's marker if typed
    markers are given. The chunks' parts of days are stored once, as all of it is made of them."""
    parts = materialize(day_parts(chunks), "day_parts")
    overlaps = _overlap(parts).groupBy(*_DAY).agg(F.sort_array(F.collect_list(F.struct("name", "category", "activity_seconds", "overlap_seconds", "overlap_percent"))).alias("overlaps"))
    out = _whole_days(parts, sleep).join(overlaps, _DAY, "left")
    if markers is not None:
        out = out.join(markers.select(*_DAY, F.struct("mood", "habits", "people", "quick_note_markdown").alias("marker")), _DAY, "left")
    return out


def typed_markers(markers: DataFrame) -> DataFrame:
    """Raw marker texts to date, map and list; what is damaged becomes null."""
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("day").try_cast("date"))
    return markers.select("tenant_id", "id", day.alias("day"), F.from_json("habits_json", "map<string,boolean>").alias("habits"), F.from_json("people_json", "array<string>").alias("people"), "quick_note_markdown", F.col("mood").try_cast("double").alias("mood"), "revision").filter("day is not null")


def calendar_metrics(chunks: DataFrame, markers: DataFrame, progress: DataFrame | None = None, sleep: str = "A0", spine: DataFrame | None = None) -> DataFrame:
    """Totals, marker and goals of every day of the spine (tenant_id, day), or of every day that has a chunk, a marker or a
    goal; what a day lacks counts 0. progress: tenant_id, period, period_start, status_text."""
    m = typed_markers(markers).select(*_DAY, "mood", (F.coalesce(F.trim("quick_note_markdown"), F.lit("")) != "").alias("has_note"), F.size("people").alias("people"), F.size(F.map_filter("habits", lambda k, v: v)).alias("habits_done"), F.size("habits").alias("habits_total"))
    parts = [day_totals(chunks, sleep), m]
    if progress is not None:
        met = F.sum(F.when(F.col("status_text") == "met", 1).otherwise(0))
        still = F.sum(F.when(F.col("status_text").isin("scheduled", "in_progress", "on_track"), 1).otherwise(0))
        parts.append(progress.filter("period = 'day'").groupBy("tenant_id", F.col("period_start").alias("day")).agg(met.alias("goals_met"), F.count("*").alias("goals_total"), still.alias("goals_open")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, _DAY, "full_outer")
    if spine is not None:
        out = spine.select(_DAY).distinct().join(out, _DAY, "left")
    counts = [c for c in out.columns if c not in (*_DAY, "mood", "has_note")]
    out = out.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in counts} | {"has_note": F.coalesce("has_note", F.lit(False))})
    return out if progress is None else out.withColumn("shade", shade(F.col("goals_met"), F.col("goals_total"), F.col("goals_open")))


def shade(met: Column, total: Column, still_open: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, "none").when(met == total, "all_met").when(still_open > 0, "open").when(met == 0, "none_met").otherwise("some_met")


def month_grid(spark, year: int, month: int, today: str, selected: str) -> DataFrame:
    """Monday-to-Sunday days that cover a month, with flags."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    start, end = F.date_trunc("week", first).cast("date"), F.date_add(F.date_trunc("week", F.last_day(first)).cast("date"), 6)
    days = spark.sql("SELECT 1 AS one").select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))).alias("day"))
    return days.select("day", (F.month("day") == month).alias("in_month"), (F.col("day") == F.lit(today).cast("date")).alias("is_today"), (F.col("day") == F.lit(selected).cast("date")).alias("is_selected"))


def day_lanes(chunks: DataFrame) -> DataFrame:
    """Blocks of each day's lanes: place and width in percent of the day, where the label goes, and a colour number."""
    start = seconds_into_day(F.col("start_timestamp"), F.col("day")) * 100.0 / 86400
    width = F.greatest(F.col(_D) * 100.0 / 86400, F.lit(0.08))
    label = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Untitled"))
    return day_parts(chunks).select(*_DAY, "source", "id", start.alias("start_percent"), width.alias("width_percent"), (width >= 5).alias("label_inside"), label.alias("label"), colour_index(label).alias("colour"))


def point_markers(points: DataFrame) -> DataFrame:
    day = F.to_date("timestamp")
    return points.select("tenant_id", day.alias("day"), "id", (seconds_into_day(F.col("timestamp"), day) * 100.0 / 86400).alias("percent"))


def month_habits(markers: DataFrame) -> DataFrame:
    """Each day's habits, completed with false for all habit names of the tenant's month."""
    m = typed_markers(markers).withColumn("month", F.date_trunc("month", "day").cast("date"))
    names = m.select("tenant_id", "month", F.explode(F.map_keys("habits")).alias("habit")).groupBy("tenant_id", "month").agg(F.array_sort(F.collect_set("habit")).alias("names"))
    full = F.map_from_entries(F.transform("names", lambda n: F.struct(n, F.coalesce(F.element_at(F.coalesce("habits", F.create_map().cast("map<string,boolean>")), n), F.lit(False)))))
    return m.join(names, ["tenant_id", "month"]).select(*_DAY, full.alias("habits"))


def daily_comparison(chunks: DataFrame, days: int) -> DataFrame:
    return _comparison(day_cells(chunks), days)


def _comparison(cells: DataFrame, days: int) -> DataFrame:
    daily = _activities(cells).groupBy(*_DAY, "name").agg(F.sum("total_seconds").alias("total_seconds"))
    return activity_day_comparison(daily, days)


def daily_note(chunks: DataFrame, issues: DataFrame | None = None, sleep: str = "A0") -> DataFrame:
    """Texts of each tenant's daily note, from the chunks' parts of days, which are stored once."""
    parts = materialize(day_parts(chunks), "day_parts")
    lines = _comparison(_cells(parts), 7)
    line = F.concat(F.col("name"), F.lit(" - "), human_duration(F.col("total_seconds")), F.lit(" | "), percent_change(F.col("total_seconds"), F.col("previous_mean")))
    activities = lines.groupBy(*_DAY).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("activity_lines"))
    over = _overlap(parts).filter("overlap_seconds > 0")
    screen = over.groupBy(*_DAY).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s: %.1f%%", "name", "overlap_percent"))), "\n").alias("screen_lines"))
    base = _whole_days(parts, sleep).join(activities, _DAY, "left").join(screen, _DAY, "left")
    out = base.select(*_DAY, iso_week(F.col("day")).alias("week"), human_duration(F.col("tracked_seconds")).alias("tracked"), text_duration(F.col("screen_seconds")).alias("screen"), human_duration(F.col("sleep_seconds")).alias("sleep"), F.coalesce("top_activity", F.lit("—")).alias("top"), F.coalesce("activity_lines", F.lit("")).alias("activity_lines"), F.coalesce("screen_lines", F.lit("")).alias("screen_lines"))
    if issues is not None:
        from .validate import report

        out = out.join(report([issues]).select("tenant_id", "status"), "tenant_id", "left").withColumn("status", F.coalesce("status", F.lit("valid")))
    return out


def note_text(note: DataFrame, formatters: dict | None = None) -> DataFrame:
    """Notes as one text each; formatters may replace the form of single fields (column -> column)."""
    get = lambda c: (formatters or {}).get(c, lambda x: x)(F.col(c)).cast("string")
    parts = [F.concat(F.lit("# "), F.date_format("day", "yyyy-MM-dd"), F.lit(" ("), get("week"), F.lit(")"))]
    parts += [F.concat(F.lit(f"- {title}: "), get(c)) for title, c in (("Tracked", "tracked"), ("Screen", "screen"), ("Sleep", "sleep"), ("Top", "top"))]
    parts += [F.lit("## Activities"), get("activity_lines"), F.lit("## Screen"), get("screen_lines")]
    return note.select(*_DAY, F.concat_ws("\n", *parts).alias("value"))


def period_kpis(chunks: DataFrame, selected: Column, current: tuple, previous: tuple) -> DataFrame:
    """Overview figures of two windows and the change between them as text."""
    from .intervals import clip
    from .stats import overview_metrics

    now, then = (overview_metrics(clip(chunks, *w), selected) for w in (current, previous))
    names = [c for c in now.columns if c != "tenant_id"]
    both = now.join(then.select("tenant_id", *[F.col(c).alias(f"previous_{c}") for c in names]), "tenant_id", "full_outer").na.fill(0)
    text = F.when(F.col("previous_tracked_seconds") == 0, F.lit("no earlier data")).otherwise(percent_change(F.col("tracked_seconds"), F.col("previous_tracked_seconds")))
    return both.withColumn("tracked_change", text)
