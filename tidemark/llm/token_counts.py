"""Exact length histogram: documents by encoded length; suffix sums answer every context limit.

Null and empty texts have length 0 (plus `extra` tokens a document). Only the text column (and the
columns named in `by`) is read, so other columns and their names don't matter. An empty table gives an
empty histogram. Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, strings

#: Lengths in one bucket of the two-level suffix sums.
BUCKET = 1024


def length_histogram(docs: DataFrame, vocabulary: str, *, text: str = "text", extra: int = 0) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length. Counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import PIECE_CHARS, encoder

        for batch in batches:
            texts = strings(batch.column(0))
            for lo, hi in pieces(texts, PIECE_CHARS):
                _, offsets = encoder(vocabulary).encode(texts[lo:hi])
                n, docs_with = np.unique(np.diff(offsets) + extra, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(docs_with, pa.int64())], ["n_tokens", "n_docs"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: documents and tokens that fit, documents cut,
    tokens kept when each document is cut at the limit, and the share of documents that fit.

    Suffix sums in two levels: inside buckets of BUCKET lengths (one window partition each), and over the
    buckets' totals, of which there are only the longest length / BUCKET.
    """
    h = histogram.withColumn("bucket", F.expr(f"n_tokens div {BUCKET}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    buckets = (
        h.groupBy("bucket")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select("bucket", total("d", above).alias("docs_above"), total("t", above).alias("tokens_above"), total("d", everything).alias("all_docs"), total("t", everything).alias("all_tokens"))
    )
    longer_docs = total("n_docs", inside) + F.col("docs_above")
    longer_tokens = total("tokens", inside) + F.col("tokens_above")
    return h.join(buckets, "bucket").select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        longer_docs.alias("docs_cut"),
        (F.col("all_docs") - longer_docs).alias("docs_fit"),
        (F.col("all_tokens") - longer_tokens).alias("tokens_fit"),
        (F.col("all_tokens") - longer_tokens + F.col("n_tokens") * longer_docs).alias("tokens_kept"),
        "all_docs",
        "all_tokens",
        ((F.col("all_docs") - longer_docs) / F.col("all_docs")).alias("fit_share"),
    )


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """One row: kept_<limit> for each of a few limits, from the histogram alone."""
    return histogram.agg(*[F.coalesce(F.sum(F.least("n_tokens", F.lit(n)) * F.col("n_docs")), F.lit(0)).alias(f"kept_{n}") for n in limits])


def quantile(table: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of all documents does not exceed."""
    return table.filter(F.col("fit_share") >= F.lit(q)).agg(F.min("context_limit").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, **kwargs) -> DataFrame:
    return limit_table(materialize(length_histogram(docs, vocabulary, **kwargs), "lengths"))
