"""Text files as numbered lines.

Spark reads a large file in blocks, and a line belongs to the block in which it begins. Rows of one block come in order, so a
line's number is the number of lines in the file's blocks before, and its place in its own block. The numbers of lines are one
small aggregate; no line is shuffled for its number while that table is small enough for Spark to send it around, and any store
that Spark reads will do. Compressed files are one block each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def placed_lines(raw: DataFrame) -> DataFrame:
    """A text table (also a stream) with the file and block of each row."""
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def number_lines(placed: DataFrame) -> DataFrame:
    """placed_lines, with nothing shuffled since they were read, with `line`, the row's number in its file from 1, and `seq`, its
    number over all files in order of paths."""
    placed = placed.withColumn("at", F.monotonically_increasing_id())
    blocks = placed.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    upto = Window.orderBy("file", "block")  # a row for each block
    before = blocks.select(
        F.col("file").alias("_file"),
        F.col("block").alias("_block"),
        (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n") - F.col("first")).alias("_in_file"),
        (F.sum("n").over(upto) - F.col("n") - F.col("first")).alias("_in_all"),
    )
    joined = placed.join(before, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    numbers = {"line": F.col("at") + 1 + F.col("_in_file"), "seq": F.col("at") + 1 + F.col("_in_all")}
    return joined.withColumns(numbers).drop("at", "block", "_file", "_block", "_in_file", "_in_all")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line, seq, and the columns of partition folders. Blank lines are rows, too."""
    return number_lines(placed_lines(spark.read.text(path)))


def write_lines(rows: DataFrame, path: str, folder: str, order: list[str], header: str | None = None) -> None:
    """The strings `value` as text files, one in each folder <folder>=<value>, in the given order; the header comes first."""
    lines = rows.select(folder, F.lit(1).alias("_rank"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(order)], "value")
    if header is not None:
        first = rows.select(folder).distinct().select(folder, F.lit(0).alias("_rank"), F.lit(header).alias("value"))
        lines = lines.unionByName(first, allowMissingColumns=True)
    keys = [folder, "_rank", *[f"_{k}" for k in range(len(order))]]
    lines.repartition(folder).sortWithinPartitions(*keys).select(folder, "value").write.partitionBy(folder).text(path)


def strictly(good: DataFrame, rejected: DataFrame) -> DataFrame:
    """good, failing when it is read if there are rejected rows; the error names file and line."""
    error = F.concat(F.lit("bad row in "), "file", F.lit(", line "), F.col("line").cast("string"), F.lit(": "), "reason")
    bad = rejected.select(F.raise_error(error).cast("string").alias("e"))
    return good.unionByName(bad.select(*[_null_of(F.col("e"), t).alias(c) for c, t in good.dtypes]))


def _null_of(text: Column, kind: str) -> Column:
    return text if kind == "string" else text.try_cast(kind)
