"""The functions of this package for SQL: register(spark) makes temporary SQL functions, which Spark inlines into plans.

split_interval is a table function: SELECT c.id, p.* FROM chunks c, LATERAL split_interval(c.start_timestamp, c.end_timestamp, 'day') p
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import UNITS


def _plural(n: str, word: str) -> str:
    return f"concat(CAST({n} AS STRING), if({n} = 1, ' {word}', ' {word}s'))"


def _units() -> str:
    whole = "CAST(bround(abs(seconds)) AS BIGINT)"
    parts = [f"({whole} DIV {size}{'' if cycle is None else f' % {cycle}'})" for _, size, cycle in UNITS]
    return ", ".join(f"if({part} > 0, concat(CAST({part} AS STRING), '{unit}'), NULL)" for part, (unit, _, _) in zip(parts, UNITS, strict=True))


_WHOLE = "greatest(coalesce(seconds, 0), 0)"
_STEP = "CASE unit WHEN 'hour' THEN INTERVAL '1' HOUR WHEN 'day' THEN INTERVAL '1' DAY WHEN 'week' THEN INTERVAL '7' DAY END"
_NEXT = "CAST(CASE unit WHEN 'hour' THEN timestampadd(HOUR, 1, p) WHEN 'day' THEN timestampadd(DAY, 1, p) WHEN 'week' THEN timestampadd(DAY, 7, p) WHEN 'month' THEN timestampadd(MONTH, 1, p) ELSE timestampadd(YEAR, 1, p) END AS TIMESTAMP_NTZ)"
_FIRST = "CAST(date_trunc(unit, from_time) AS TIMESTAMP_NTZ)"
_LAST = "CAST(date_trunc(unit, timestampadd(MICROSECOND, -1, to_time)) AS TIMESTAMP_NTZ)"
_PERIODS = f"CASE WHEN from_time >= to_time THEN array() WHEN unit IN ('month', 'year') THEN sequence({_FIRST}, {_LAST}, if(unit = 'month', INTERVAL '1' MONTH, INTERVAL '12' MONTH)) ELSE sequence({_FIRST}, {_LAST}, {_STEP}) END"

#: name: (parameters, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "human_duration": (
        "seconds DOUBLE",
        "STRING",
        f"CASE WHEN seconds IS NULL OR isnan(seconds) OR abs(seconds) = double('Infinity') THEN '—' WHEN CAST(bround(abs(seconds)) AS BIGINT) = 0 THEN '0s' ELSE concat(if(seconds < 0, '-', ''), concat_ws(' ', {_units()})) END",
    ),
    "text_duration": (
        "seconds BIGINT",
        "STRING",
        f"CASE WHEN {_WHOLE} < 60 THEN '0 minutes' ELSE concat_ws(' ', if({_WHOLE} >= 3600, {_plural(f'({_WHOLE} DIV 3600)', 'hour')}, NULL), if({_WHOLE} DIV 60 % 60 > 0, {_plural(f'({_WHOLE} DIV 60 % 60)', 'minute')}, NULL)) END",
    ),
    "clock_duration": (
        "seconds BIGINT, with_seconds BOOLEAN DEFAULT false",
        "STRING",
        "concat_ws(':', CAST(floor(seconds / 3600) AS STRING), lpad(CAST(floor(seconds / 60) % 60 AS STRING), 2, '0'), if(with_seconds, lpad(CAST(seconds % 60 AS STRING), 2, '0'), NULL))",
    ),
    "iso_week": ("day DATE", "STRING", "concat(CAST(extract(YEAROFWEEK FROM day) AS STRING), '-W', lpad(CAST(weekofyear(day) AS STRING), 2, '0'))"),
    "period_label": (
        "start TIMESTAMP_NTZ, unit STRING",
        "STRING",
        "CASE unit WHEN 'week' THEN concat(CAST(extract(YEAROFWEEK FROM start) AS STRING), '-W', lpad(CAST(weekofyear(start) AS STRING), 2, '0')) WHEN 'year' THEN date_format(start, 'yyyy') WHEN 'month' THEN date_format(start, 'yyyy-MM') WHEN 'day' THEN date_format(start, 'yyyy-MM-dd') WHEN 'hour' THEN date_format(start, 'yyyy-MM-dd HH:mm') END",
    ),
    "percent_change": ("now DOUBLE, before DOUBLE", "STRING", "format_string('%+.1f%%', CASE WHEN before = 0 THEN if(now = 0, 0.0D, 100.0D) ELSE (now - before) * 100.0D / before END)"),
    "activity_label": ("category STRING, name STRING, separator STRING DEFAULT ' · ', name_first BOOLEAN DEFAULT true", "STRING", "concat_ws(separator, nullif(if(name_first, name, category), ''), nullif(if(name_first, category, name), ''))"),
    "parse_people": ("names STRING", "ARRAY<STRING>", "array_distinct(filter(transform(split(coalesce(names, ''), '[,\n]'), x -> trim(x)), x -> x <> ''))"),
    "parse_mood": ("mood STRING", "DOUBLE", "try_cast(nullif(trim(mood), '') AS DOUBLE)"),
    "parse_event_time": ("time STRING", "TIMESTAMP_NTZ", "try_cast(time AS TIMESTAMP_NTZ)"),
    "split_task": (
        "task STRING",
        "STRUCT<category: STRING, name: STRING>",
        "CASE WHEN task IS NOT NULL THEN named_struct('category', if(instr(task, ':') > 0, nullif(trim(substring(task, 1, instr(task, ':') - 1)), ''), NULL), 'name', if(instr(task, ':') > 0, trim(substring(task, instr(task, ':') + 1)), trim(task))) END",
    ),
    "habits_map": ("habits_json STRING", "MAP<STRING, BOOLEAN>", "from_json(habits_json, 'map<string, boolean>')"),
    "people_list": ("people_json STRING", "ARRAY<STRING>", "from_json(people_json, 'array<string>')"),
    "seconds_into_day": ("time TIMESTAMP_NTZ, day DATE", "BIGINT", "least(greatest(timestampdiff(SECOND, CAST(day AS TIMESTAMP_NTZ), time), 0), 86400)"),
}
TABLE_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "split_interval": (
        "from_time TIMESTAMP_NTZ, to_time TIMESTAMP_NTZ, unit STRING",
        "TABLE (period TIMESTAMP_NTZ, start_timestamp TIMESTAMP_NTZ, end_timestamp TIMESTAMP_NTZ, duration_seconds BIGINT)",
        f"SELECT p, greatest(from_time, p), least(to_time, {_NEXT}), timestampdiff(SECOND, greatest(from_time, p), least(to_time, {_NEXT})) FROM (SELECT explode({_PERIODS}) AS p)",
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions in the session; those of an earlier call are replaced."""
    for name, (parameters, kind, body) in (FUNCTIONS | TABLE_FUNCTIONS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
