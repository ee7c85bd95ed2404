"""Filter interaction audit: what five filters remove in each order, and which of them the others make redundant.

Words decide A and B, over a sparse document-term matrix: tasks encode the words of some documents by a dictionary of their own
and write them as a shard in compressed sparse rows; the words of all shards' dictionaries meet by word and get their numbers in one
dictionary over the whole table, and each shard's columns are renumbered by it. Row sums are numbers of words, nonzero counts numbers of distinct words.

A document's failed filters are a mask of five bits. Documents are counted by part, mask and label before anything else, so all
120 orders are worked out over 32 counts a part.

A null text is empty; a null part is the empty string. Duplicates (E) are judged over the whole table; a null id is neither
smaller nor larger than another, so rows with one never fail E. Rows of equal id are not smaller than each other. Repeated rows
count each. A document with several labels is good or toxic if one of them says so; labels without a document count nothing. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, scratch, strings

FILTERS = "ABCDE"
#: Words a document must have (A), percent of them that must be distinct (B), percent of capitals that it may have (C).
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
MARKS = "[#$%&*|]"
#: Code points in one shard of the matrix, and in one piece of its texts; a longer text is one by itself.
SHARD_CHARS, PIECE_CHARS = 16_000_000, 1_000_000
_SHARD_BITS = 24
#: Terms of one partition of the dictionary.
_TERM_BITS = 40


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of other characters than space and \\t to \\r, and each one's row."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty element
    return words.filter(real), row[real.to_numpy(zero_copy_only=False)]


def compressed_rows(row: np.ndarray, column: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row bounds, columns and counts of a matrix of occurrences."""
    width = int(column.max(initial=0)) + 1
    cells, counts = np.unique(row * width + column, return_counts=True)
    return np.searchsorted(cells, np.arange(rows + 1) * width), cells % width, counts


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in few bytes: shards are stored and then shuffled. Most high bytes are zeros, so they go together."""
    raw = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _numbers(values: pa.Array) -> np.ndarray:
    """Whole numbers stored by _packed in a column of one row."""
    stored = values[0].as_py()
    raw = pa.Codec("zstd").decompress(stored[8:], int.from_bytes(stored[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _shard(number: int, parts: list[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """One shard from pieces (attributes, cells a row, columns by their own dictionary, counts): one dictionary for all."""
    columns = pa.chunked_array([p[2] for p in parts]).unify_dictionaries().combine_chunks()
    words = columns.dictionary.cast(pa.large_binary())
    bounds = np.cumsum(np.concatenate([[0], *(p[1] for p in parts)]))
    arrays = [bounds, columns.indices.to_numpy(), np.concatenate([p[3] for p in parts]), pc.binary_length(words).to_numpy()]
    attributes = pa.concat_arrays([p[0] for p in parts])
    values = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(attributes)], pa.int32()), attributes)]
    values += [pa.array([_packed(x)], pa.binary()) for x in arrays]
    letters = pa.py_buffer(b"") if not len(words) else words.buffers()[2]
    return pa.RecordBatch.from_arrays([*values, pa.array([letters.to_pybytes()], pa.binary())], ["shard", "attributes", "bounds", "columns", "counts", "lengths", "letters"])


def _local_shards(docs: DataFrame, text: str) -> DataFrame:
    """Shards with dictionaries of their own; `attributes` are the rows' other columns."""
    rest = F.struct(*[c for c in docs.columns if c != text])
    rows = docs.select(rest.alias("attributes"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << _SHARD_BITS)
        parts, chars = [], 0
        for batch in batches:
            texts, attributes = strings(batch.column(1)), batch.column(0)
            for lo, hi in pieces(texts, PIECE_CHARS):
                words, row = words_of(texts[lo:hi])
                coded = words.dictionary_encode()
                bounds, columns, counts = compressed_rows(row, coded.indices.to_numpy().astype(np.int64), hi - lo)
                own = attributes.take(pa.array(np.arange(lo, hi)))  # a copy: a slice would hold the texts, too
                parts.append((own, np.diff(bounds), pa.DictionaryArray.from_arrays(pa.array(columns, pa.int32()), coded.dictionary), counts))
                chars += int(pc.sum(pc.utf8_length(texts[lo:hi])).as_py() or 0)
                if chars >= SHARD_CHARS:
                    yield _shard(next(number), parts)
                    parts, chars = [], 0
                    pa.default_memory_pool().release_unused()
        if parts:
            yield _shard(next(number), parts)

    kind = rows.schema["attributes"].dataType.simpleString()
    return rows.mapInArrow(build, f"shard long, attributes array<{kind}>, bounds binary, columns binary, counts binary, lengths binary, letters binary")


def _numbered_words(shards: DataFrame) -> DataFrame:
    """shard, local, term, word: each shard's words with their numbers in the dictionary over all shards; `word` is set in one
    row of each term. A word meets itself from all shards in one place, once from each."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ends = np.cumsum(_numbers(one.column(1)), dtype=np.int32)
                word = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([np.zeros(1, np.int32), ends])), one.column(2)[0].as_buffer())
                for at in range(0, len(ends), 1 << 16):
                    some = word[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([some, pa.array(np.full(len(some), one.column(0)[0].as_py())), pa.array(np.arange(at, at + len(some), dtype=np.int32))], ["word", "shard", "local"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, last = (TaskContext.get().partitionId() << _TERM_BITS) - 1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0)
            new = np.ones(len(word), bool)
            new[1:] = pc.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)
            new[0] = word[0].as_py() != last
            terms = term + np.cumsum(new)
            term, last = int(terms[-1]), word[-1].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(terms), pc.if_else(pa.array(new), word, None)], ["shard", "local", "term", "word"])

    rows = shards.select("shard", "lengths", "letters").mapInArrow(words, "word string, shard long, local int")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(number, "shard long, local int, term long, word string")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each shard, in the order of its own dictionary, as bytes."""
    shard, held = None, []
    row = lambda: pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["shard", "numbers"])
    for batch in batches:
        of, terms = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        starts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b > a and shard != of[a]:
                if shard is not None:
                    yield row()
                shard, held = int(of[a]), []
            held.append(terms[a:b].tobytes())
    if shard is not None:
        yield row()


def document_term_matrix(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Shards (shard, attributes, and as bytes of numbers: bounds, terms, counts) of the matrix, and its dictionary (word, term)."""
    joined, dictionary = _encoded(docs, text)

    def renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, terms in _renumbered(batches):
            bounds, counts = (pa.array([_numbers(one.column(k)).tobytes()], pa.binary()) for k in (2, 4))
            yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), bounds, pa.array([terms.tobytes()], pa.binary()), counts], ["shard", "attributes", "bounds", "terms", "counts"])

    kind = joined.schema["attributes"].dataType.simpleString()
    return joined.mapInArrow(renumber, f"shard long, attributes {kind}, bounds binary, terms binary, counts binary"), dictionary


def _encoded(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Shards with the terms of their own words, and the dictionary."""
    shards = materialize(_local_shards(docs, text), "shards", compression="zstd")
    numbered = materialize(_numbered_words(shards), "words", compression="zstd")
    of_shard = numbered.select("shard", "local", "term").repartition("shard").sortWithinPartitions("shard", "local").mapInArrow(_listed, "shard long, numbers binary")
    joined = shards.select("shard", "attributes", "bounds", "columns", "counts").join(of_shard, "shard", "left")
    return joined, numbered.filter("word IS NOT NULL").select("word", "term")


def _renumbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each shard, and its cells' terms."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            terms = np.frombuffer(one.column(5)[0].as_py() or b"", np.int64)  # null where no row has a word
            yield one, terms[_numbers(one.column(3))]


def row_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' other columns with n_words (row sums of the matrix) and n_distinct (nonzero counts)."""
    joined, _ = _encoded(docs, text)
    row = joined.schema["attributes"].dataType.elementType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, terms in _renumbered(batches):
            bounds = _numbers(one.column(2))
            sums = np.concatenate([[0], np.cumsum(_numbers(one.column(4)), dtype=np.int64)])[bounds]
            distinct = np.add.reduceat(np.append(terms >= 0, False), bounds[:-1], dtype=np.int64) * (np.diff(bounds) > 0)
            yield pa.RecordBatch.from_arrays([one.column(1).flatten(), pa.array(np.diff(sums)), pa.array(distinct)], ["attributes", "n_words", "n_distinct"])

    return joined.mapInArrow(count, f"attributes {row.simpleString()}, n_words long, n_distinct long").select("attributes.*", "n_words", "n_distinct")


def failed_filters(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part, mask (a bit for each failed filter, A the lowest), n (documents that are equal in all of this and in text)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    capitals = F.regexp_count(whole, F.lit("[A-Z]"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        (F.lit(100) * capitals > F.lit(MAX_CAPITALS) * F.length(whole)).alias("c"),
        whole.rlike(MARKS).alias("d"),
        whole.alias("text"),
    )
    counted = row_counts(rows)
    a, b = F.col("n_words") < MIN_WORDS, F.lit(100) * F.col("n_distinct") < F.lit(MIN_DISTINCT) * F.col("n_words")
    bits = a.cast("int") + b.cast("int") * 2 + F.col("c").cast("int") * 4 + F.col("d").cast("int") * 8
    judged = materialize(counted.groupBy("doc_id", "digest", "part", bits.alias("bits")).agg(F.count("*").alias("n")), "judged")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return judged.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("bits") + later.cast("int") * 16).alias("mask"), "n")


def _orders() -> Column:
    """All orders and steps: filter_order, step, bit (of the step's filter), before (bits of those before it)."""
    rows = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    with scratch(docs.sparkSession) as keep:
        failed = failed_filters(docs, doc_id=doc_id, text=text, part=part)
        said = labels.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.expr("quality = 1")).alias("good"), F.max(F.expr("toxic = 1")).alias("toxic"))
        is_label = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
        counts = keep(failed.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), is_label("good"), is_label("toxic")), "masks")
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = cells.select("part", "cells", F.inline(_orders()))

    def total(value, when) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(when(c["mask"]), value(c)).otherwise(0))

    fails = lambda mask: mask.bitwiseAND(F.col("bit")) != 0
    gone = lambda mask: mask.bitwiseAND(F.col("before")) != 0
    here = lambda mask: fails(mask) & ~gone(mask)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["n"], lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(lambda c: c["n"], here).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        # each of the k filters that a document fails is the first of them in 120 / k orders
        total(lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )
