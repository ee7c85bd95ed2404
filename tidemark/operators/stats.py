"""Aggregates, shares, pivots, windows and comparisons over chunks. All keep tenants apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import human_duration
from .carry import neighbour
from .intervals import split

_D = "duration_seconds"
METRICS = {
    "sessions": lambda: F.count("*"),
    "total_seconds": lambda: F.sum(_D),
    "mean_seconds": lambda: F.avg(_D),
    "median_seconds": lambda: F.median(_D),
    "min_seconds": lambda: F.min(_D),
    "max_seconds": lambda: F.max(_D),
}
_T = "tenant_id"


def metrics(names=tuple(METRICS)) -> list[Column]:
    unknown = set(names) - set(METRICS)
    if unknown:
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    return [METRICS[n]().alias(n) for n in names]


def scalar_stats(chunks: DataFrame, by: tuple[str, ...] = (_T,)) -> DataFrame:
    """Sessions, totals and spread; zeros without rows when by is empty, a null deviation for one row."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    aggs = [F.count("*").alias("sessions"), zero(F.sum(_D)).alias("total_seconds"), zero(F.sum(_D) / 3600.0).alias("total_hours"), zero(F.avg(_D)).alias("mean_seconds"), zero(F.median(_D)).alias("median_seconds"), zero(F.min(_D)).alias("min_seconds"), zero(F.max(_D)).alias("max_seconds"), F.stddev_samp(_D).alias("std_seconds")]
    return chunks.groupBy(*by).agg(*aggs)


def summary(chunks: DataFrame) -> DataFrame:
    """Eight rows of metric and text for each tenant."""
    s = scalar_stats(chunks)
    rows = [("Sessions", F.col("sessions").cast("string")), ("Total", human_duration(F.col("total_seconds")))]
    rows += [("Hours", F.format_string("%.2f", F.col("total_hours")))]
    rows += [(n, human_duration(F.col(c))) for n, c in (("Mean", "mean_seconds"), ("Median", "median_seconds"), ("Shortest", "min_seconds"), ("Longest", "max_seconds"), ("Deviation", "std_seconds"))]
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in rows])
    return s.select(_T, F.explode(cells).alias("x")).select(_T, "x.metric", "x.value")


def by_activity(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(_T, "category", "name").agg(*metrics())


def by_category(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(_T, "category").agg(*metrics())


def by_day(chunks: DataFrame) -> DataFrame:
    """By the day in which a chunk starts, unsplit."""
    return chunks.groupBy(_T, F.to_date("start_timestamp").alias("day")).agg(*metrics())


def daily_average(chunks: DataFrame) -> DataFrame:
    daily = chunks.groupBy(_T, F.to_date("start_timestamp").alias("day")).agg(F.sum(_D).alias("total_seconds"))
    return daily.groupBy(_T).agg(F.count("*").alias("days"), F.avg("total_seconds").alias("daily_average_seconds"))


def share(chunks: DataFrame, by: list[str], metric: str = "total_seconds") -> DataFrame:
    """Percent of a tenant's sum; tenants whose sum is 0 give no rows."""
    g = chunks.groupBy(_T, *by).agg(*metrics(("total_seconds", "sessions")))
    whole = F.sum(metric).over(Window.partitionBy(_T))
    return g.withColumn("whole", whole).filter("whole > 0").withColumn("percent", F.col(metric) * 100.0 / F.col("whole")).drop("whole")


def activity_share(chunks: DataFrame) -> DataFrame:
    return share(chunks, ["category", "name"])


def describe(chunks: DataFrame) -> DataFrame:
    """Quartiles are linear between neighbours."""
    p = lambda q: F.percentile(_D, F.lit(q)).alias(f"p{int(q * 100)}")
    return chunks.groupBy(_T).agg(F.count(_D).alias("count"), F.sum(F.when(F.col(_D).isNull(), 1).otherwise(0)).alias("null_count"), F.avg(_D).alias("mean"), F.stddev_samp(_D).alias("std"), F.min(_D).alias("min"), p(0.25), p(0.5), p(0.75), F.max(_D).alias("max"))


def summarize(chunks: DataFrame, by: list[str] | None = None, names=("sessions", "total_seconds")) -> DataFrame:
    return chunks.groupBy(_T, *(by or [])).agg(*metrics(names))


def over_time(chunks: DataFrame, period: str, by: list[str] | None = None, names=("sessions", "total_seconds")) -> DataFrame:
    """Chunks are cut at period boundaries first; sessions count the parts."""
    return split(chunks, period).groupBy(_T, "period", *(by or [])).agg(*metrics(names))


def pivot(chunks: DataFrame, index: str, columns: str, values: list[str], metric: str = "total_seconds") -> DataFrame:
    """index x values of columns; missing cells are 0. The values are given, so no pass is spent on finding them."""
    return chunks.groupBy(_T, index).pivot(columns, values).agg(METRICS[metric]()).na.fill(0, values)


def activity_total(chunks: DataFrame, name: str) -> DataFrame:
    hit = F.lower("name") == name.lower()
    return chunks.groupBy(_T).agg(F.sum(F.when(hit, F.col(_D)).otherwise(0)).alias("seconds"))


def event_type_counts(log: DataFrame, columns: list[str]) -> DataFrame:
    return log.groupBy(*columns).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def duration_audit(intervals: DataFrame, by: list[str]) -> DataFrame:
    return intervals.groupBy(*by).agg(F.count("*").alias("intervals"), (F.sum(_D) / 3600.0).alias("hours"), F.median(_D).alias("median"), F.percentile(_D, F.lit(0.95)).alias("p95"), F.max(_D).alias("max"))


def anomaly_counts(frames: list[DataFrame]) -> DataFrame:
    """Counts by source and anomaly over frames of different shapes."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole.groupBy("source", "anomaly").agg(F.count("*").alias("n"))


def sessions_by_name(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(_T, "name").agg(F.count("*").alias("sessions"), F.sum(_D).alias("total_seconds"), F.avg(_D).alias("average_seconds"), F.max(_D).alias("longest_seconds"))


def screen_seconds(chunks: DataFrame) -> Column:
    """Sum over a phone's screen-on chunks."""
    return F.sum(F.when((F.col("source") == "phone") & (F.col("category") == "Screen") & (F.col("name") == "Screen on"), F.col(_D)).otherwise(0))


def overview_metrics(chunks: DataFrame, selected: Column) -> DataFrame:
    """Tracked seconds, sessions and average of the selected chunks, beside all screen seconds, in one pass."""
    mine = F.when(F.coalesce(selected, F.lit(False)), F.col(_D))
    return chunks.groupBy(_T).agg(F.coalesce(F.sum(mine), F.lit(0)).alias("tracked_seconds"), F.count(mine).alias("sessions"), F.coalesce(F.avg(mine), F.lit(0.0)).alias("average_seconds"), screen_seconds(chunks).alias("screen_seconds"))


# windows


def rolling(chunks: DataFrame, period: str, window: int, by: list[str] | None = None, metric: str = "total_seconds") -> DataFrame:
    """Mean of a metric over the last `window` rows (not calendar periods) of each group."""
    if window < 1:
        raise ValueError("window must be positive")
    by = by or []
    w = Window.partitionBy(_T, *by).orderBy("period").rowsBetween(1 - window, 0)
    return over_time(chunks, period, by, (metric,)).withColumn("rolling", F.avg(metric).over(w))


def sequenced(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Each chunk beside the one before it, over all sources of a tenant."""
    columns = {f"previous_{c}": c for c in [*by, "end_timestamp", _D]} | {"previous_id": "id"}
    out = neighbour(chunks, [_T], ["start_timestamp", "id"], columns)
    return out.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("previous_end_timestamp"), F.col("start_timestamp")))


def transitions(chunks: DataFrame, by: list[str], max_gap_seconds: int | None = None, include_same: bool = True) -> DataFrame:
    """Counts of what follows what. Rows whose predecessor has no first key are left out; gaps are bounded by 0 and the
    maximum if one is given."""
    s = sequenced(chunks, by).filter(F.col("previous_id").isNotNull() & F.col(f"previous_{by[0]}").isNotNull())
    if max_gap_seconds is not None:
        s = s.filter(F.col("gap_seconds").between(0, max_gap_seconds))
    if not include_same:
        differs = F.lit(False)
        for c in by:
            differs = differs | (F.col(c) != F.col(f"previous_{c}"))
        s = s.filter(differs)
    return s.groupBy(_T, *(f"previous_{c}" for c in by), *by).agg(F.count("*").alias("transitions"), F.avg("gap_seconds").alias("mean_gap_seconds"), F.median("gap_seconds").alias("median_gap_seconds"), F.sum(_D).alias("next_total_seconds"), F.avg(_D).alias("next_mean_seconds"))


def top_chunks(chunks: DataFrame, n: int, *, longest: bool = True) -> DataFrame:
    """The n longest (or shortest) chunks of each tenant, ranked."""
    order = F.desc(_D) if longest else F.asc(_D)
    return chunks.withColumn("rank", F.row_number().over(Window.partitionBy(_T).orderBy(order, "id")).cast("long")).filter(F.col("rank") <= n)


def top_activity(chunks: DataFrame, exclude: tuple[str, ...] = (), by: tuple[str, ...] = ("name",)) -> DataFrame:
    """The activity with the largest total, ties by name; excluded names are compared in lower case, null names drop out."""
    kept = chunks.filter(F.col("name").isNotNull() & ~F.lower("name").isin(*[x.lower() for x in exclude])) if exclude else chunks.filter("name is not null")
    totals = kept.groupBy(_T, *by).agg(F.sum(_D).alias("total_seconds"))
    w = Window.partitionBy(_T).orderBy(F.desc("total_seconds"), *by)
    return totals.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def default_activities(chunks: DataFrame, limit: int) -> DataFrame:
    """The limit largest names of each tenant and day, ties by name."""
    totals = chunks.filter("name is not null").groupBy(_T, F.to_date("start_timestamp").alias("day"), "name").agg(F.sum(_D).alias("total_seconds"))
    w = Window.partitionBy(_T, "day").orderBy(F.desc("total_seconds"), "name")
    return totals.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def overlap_check(chunks: DataFrame) -> DataFrame:
    """Chunks that start before their source's previous chunk ends."""
    before = neighbour(chunks, [_T, "source"], ["start_timestamp", "end_timestamp", "id"], {"previous_end": "end_timestamp"})
    return before.filter("start_timestamp < previous_end")


def top_labels(chunks: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(_T).orderBy(F.desc("total_seconds"), "category", "name")
    return activity_share(chunks).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def top_n_composition(chunks: DataFrame, period: str, n: int = 6) -> DataFrame:
    """over_time of the n activities with the largest share; null categories match nothing."""
    keys = [_T, "category", "name"]
    return over_time(chunks, period, ["category", "name"]).join(top_labels(chunks, n).select(keys), keys, "left_semi")


def dense_series(chunks: DataFrame, period: str) -> DataFrame:
    """Every period x name of a tenant, 0 where there is nothing."""
    rows = over_time(chunks.filter("name is not null"), period, ["name"], ("total_seconds",))
    grid = rows.select(_T, "period").distinct().join(rows.select(_T, "name").distinct(), _T)
    return grid.join(rows, [_T, "period", "name"], "left").select(_T, "period", "name", F.coalesce("total_seconds", F.lit(0)).alias("total_seconds"))


def top_activities_progress(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The n largest activities and their share of those n."""
    top = top_labels(chunks, n).drop("percent")
    return top.withColumn("progress", F.col("total_seconds") / F.sum("total_seconds").over(Window.partitionBy(_T)))


# comparisons


def compare(left: DataFrame, right: DataFrame, by: list[str], metric: str = "total_seconds", labels: tuple[str, str] = ("current", "previous")) -> DataFrame:
    """A metric of two slices side by side: missing values are 0, null keys match nothing, the percentage is null where the
    other value is 0."""
    a = left.groupBy(_T, *by).agg(METRICS[metric]().alias(labels[0]))
    b = right.groupBy(_T, *by).agg(METRICS[metric]().alias(labels[1]))
    out = a.join(b, [_T, *by], "full_outer").na.fill(0, list(labels))
    delta = F.col(labels[0]) - F.col(labels[1])
    return out.withColumn("delta", delta).withColumn("delta_percent", F.when(F.col(labels[1]) != 0, F.col("delta") * 100.0 / F.col(labels[1])))


def activity_day_comparison(daily: DataFrame, days: int) -> DataFrame:
    """Each day's seconds of an activity beside the mean of its daily totals over the `days` days before (days with data).

    daily: tenant_id, day, name, total_seconds, one row each; a date range window does it without a self join.
    """
    number = F.date_diff(F.col("day"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(_T, "name").orderBy("n").rangeBetween(-days, -1)
    return daily.withColumn("n", number).withColumn("previous_mean", F.coalesce(F.avg("total_seconds").over(w), F.lit(0.0))).drop("n")


def screen_vs_activity(chunks: DataFrame, period: str, n: int) -> DataFrame:
    """over_time rows with their activity's rank and share; null categories match nothing."""
    keys = [_T, "category", "name"]
    return over_time(chunks, period, ["category", "name"]).join(top_labels(chunks, n).select(*keys, "rank", "percent"), keys)
