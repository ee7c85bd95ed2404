"""The versioned chunk table: isolation, pruning, expiry."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.filters import TimelineQuery
from tidemark.sources.versions import VersionedTable

SCHEMA = "tenant_id long, id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, category string, name string, source string, duration_seconds long"
T0 = datetime(2026, 5, 1, 22)


def made(spark, days, shift=0):
    rows = [(k % 2, k + shift, T0 + timedelta(days=k), T0 + timedelta(days=k, hours=4 if k != 3 else 60), "c", "n", "pc", 3600 * (4 if k != 3 else 60)) for k in range(days)]
    return spark.createDataFrame([*rows, (0, 999, None, None, "c", "n", "pc", None)], SCHEMA)


def test_readers_keep_their_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t")).create()
    with pytest.raises(LookupError):
        table.read()
    assert table.write(made(spark, 10)) == 1
    first = table.read()
    assert table.write(made(spark, 4, shift=100)) == 2
    assert first.count() == 11 and table.read().count() == 5 and table.read(1).count() == 11
    assert {r.id for r in table.read().collect()} == {100, 101, 102, 103, 999}
    assert VersionedTable(spark, str(tmp_path / "t")).create().current().version == 2
    assert table.expire(keep=1) == [1] and table.read().count() == 5


def test_a_failed_write_is_not_seen(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t")).create()
    table.write(made(spark, 3))
    with pytest.raises(Exception, match="stop"):
        table.write(made(spark, 5).withColumn("name", F.raise_error(F.lit("stop")).cast("string")))
    assert table.current().version == 1 and table.read().count() == 4


def test_overlap_reads_few_dates(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t")).create()
    table.write(made(spark, 30))
    start, end = datetime(2026, 5, 6, 1), datetime(2026, 5, 7, 23)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = table.overlapping(start, end)
    want = [r.id for r in made(spark, 30).collect() if r.start_timestamp and r.end_timestamp > start and r.start_timestamp < end]
    assert sorted(r.id for r in found.collect()) == want and 3 in want  # the long one begins two days before
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in x)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "start_date#" in scan and ">= 2026-05-03" in scan and "<= 2026-05-07" in scan and " IN (" in scan
    assert {f.split("start_date=")[1][:10] for f in found.inputFiles()} >= {"2026-05-04"}
    clipped = table.clipped(TimelineQuery().between(start, end))
    assert clipped.agg(F.min("start_timestamp"), F.max("end_timestamp")).first()[0] == start
    assert table.overlapping(datetime(2020, 1, 1), datetime(2020, 1, 2)).count() == 0
    empty = VersionedTable(spark, str(tmp_path / "e")).create()
    empty.write(made(spark, 1).limit(0))
    assert empty.read().count() == 0 and empty.overlapping(start, end).count() == 0
