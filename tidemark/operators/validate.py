"""Data-quality issues as rows (tenant_id, severity, table, object_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import neighbour


def _issues(df: DataFrame, table: str, object_id: str, checks: list[tuple[Column, str]], severity: str = "ERROR") -> DataFrame:
    found = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))
    return df.select("tenant_id", F.lit(severity).alias("severity"), F.lit(table).alias("table"), F.col(object_id).cast("long").alias("object_id"), F.explode(found).alias("message"))


def event_fields(events: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return _issues(events, "events", "id", [(blank("category"), "category is missing"), (blank("name"), "name is missing")])


def chunk_checks(chunks: DataFrame) -> DataFrame:
    before = neighbour(chunks, ["tenant_id", "source"], ["start_timestamp", "end_timestamp", "id"], {"previous_end": "end_timestamp"})
    return _issues(before, "chunks", "id", [(F.col("end_timestamp") < F.col("start_timestamp"), "end before start"), (F.col("start_timestamp") < F.col("previous_end"), "overlaps the previous chunk")])


def marker_checks(markers: DataFrame) -> DataFrame:
    """On the raw texts: dates, JSON shapes, notes and moods."""
    day = F.when(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("day").try_cast("date"))
    repeated = F.count("*").over(Window.partitionBy("tenant_id", "day")) > 1
    later = F.row_number().over(Window.partitionBy("tenant_id", "day").orderBy("id")) > 1
    shape = lambda c: F.schema_of_variant(F.try_parse_json(c))
    rows = markers.withColumns({"repeated": repeated & later, "habits_shape": shape(F.col("habits_json")), "people_shape": shape(F.col("people_json"))})
    booleans = F.col("habits_shape").rlike(r"^OBJECT<(([^:,<>]|`[^`]*`)+: BOOLEAN(, )?)*>$")
    strings = F.col("people_shape").isin("ARRAY<STRING>", "ARRAY<VOID>")
    return _issues(
        rows,
        "day_markers",
        "id",
        [
            (day.isNull(), "day is not an ISO date"),
            (F.col("repeated"), "day occurs twice"),
            (F.col("habits_shape").isNull(), "habits are not valid JSON"),
            (F.col("habits_shape").isNotNull() & ~booleans, "habits are not an object of booleans"),
            (F.col("people_shape").isNull(), "people are not valid JSON"),
            (F.col("people_shape").isNotNull() & ~strings, "people are not a list of strings"),
            (F.col("quick_note_markdown").isNull(), "note is missing"),
            (F.col("mood").isNotNull() & F.col("mood").try_cast("double").isNull(), "mood is not a number"),
        ],
    )


def report(issues: list[DataFrame]) -> DataFrame:
    """Per tenant with an issue: counts, whether it is valid, and a status text."""
    whole = reduce(DataFrame.unionByName, issues)
    count = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0))
    g = whole.groupBy("tenant_id").agg(count("ERROR").alias("errors"), count("WARNING").alias("warnings"))
    text = F.when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" errors, "), F.col("warnings").cast("string"), F.lit(" warnings"))).otherwise(F.concat(F.lit("valid, "), F.col("warnings").cast("string"), F.lit(" warnings")))
    return g.withColumn("valid", F.col("errors") == 0).withColumn("status", text)
