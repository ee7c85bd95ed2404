"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one gets a fresh folder; a cluster must name one, as a folder of this
    machine is none of its executors'."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cut lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{_scratch.get() or shared_dir(spark) + '/tables'}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(stored: DataFrame) -> None:
    """Delete a table of materialize() once everything made from it is stored itself. Shuffle files of finished jobs go when
    the driver's garbage is collected, so that is done, too."""
    spark = stored.sparkSession
    delete(spark, stored.stored_at)
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables that are materialized inside are deleted at the end; what is yielded stores a result outside of them."""
    outer, folder = _scratch.get(), f"{shared_dir(spark)}/tables/scratch-{uuid.uuid4().hex}"

    def keep(df: DataFrame, tag: str, **options: str) -> DataFrame:
        inner = _scratch.set(outer)
        try:
            return materialize(df, tag, **options)
        finally:
            _scratch.reset(inner)

    token = _scratch.set(folder)
    try:
        yield keep
    finally:
        _scratch.reset(token)
        delete(spark, folder)
