"""Suffix-array dedup: bytes of texts that stand in a string of `length` bytes which also starts earlier.

Earlier means in a document with a smaller id, or before in the same document; matches never cross documents, strings overlap
freely and are judged on the input. Texts are taken whole, as UTF-8 bytes.

1. Every string of `length` bytes holds an anchor: of its runs of `length` / 2 bytes the one with the smallest hash, the first
   of equal ones. Neighbouring strings mostly share one and form a piece: the anchor and what stands around it. Equal strings
   have equal anchors at the same place, so only pieces with equal anchors can share a string. Anchors are counted, and pieces
   with an anchor that occurs once are dropped.
2. Of equal pieces all but the first are repeats as a whole.
3. Different pieces with one anchor meet in one task. There their suffix array (suffix_groups.py; the anchor is one symbol)
   brings equal strings together, and all but the first one are repeats.

An anchor with more than `limit` different pieces is split: first by pieces, and what is left of their strings by strings, so
that no group of pieces is larger than a task holds, however many documents share a passage.

Null texts are empty. Texts shorter than `length` bytes have no string. Rows with a null id follow all others. Rows of one id
with different texts are ordered by a hash of the text; rows equal in id and text (or in text, with null ids) are one document,
and all of them get its result. An empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_stream, materialize, mix, powers_to, scratch, spread, strings
from .suffix_groups import suffix_array, turns

#: Bytes hashed at once inside a task; longer texts go in slices.
SLICE = 1 << 19
#: Different pieces of one anchor that one task sorts.
LIMIT = 8192
#: Bits of a position inside a slice, in the keys that find anchors; the rest is hash.
_PLACE_BITS = 22
#: Bits of a position inside a text, and of the hash that orders texts with one id.
_AT, _TIE = 31, 32
_NO_ID = (1 << 63) - 1
_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 21)


@dataclass(frozen=True)
class Pieces:
    """Pieces of some texts: row, first byte of the first string, anchor's place after it, strings after the first one, hash of
    the anchor, hash of the whole."""

    row: np.ndarray
    at: np.ndarray
    before: np.ndarray
    more: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray


def _slices(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Bytes of whole rows, or of a part of one long row, with row numbers, row bounds, and the part's place in its row."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, side="right")) - 1)
        begin, stop = int(offsets[k]), int(offsets[end])
        if stop - begin <= SLICE:
            yield data[begin:stop], np.arange(k, end), offsets[k : end + 1] - begin, 0
        else:
            for at in range(begin, stop - length + 1, SLICE):
                part = data[at : min(stop, at + SLICE + length - 1)]
                yield part, np.array([k]), np.array([0, len(part)]), at - begin
        k = end


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours."""
    found, n = keys, len(keys) - width + 1
    reach = 1
    while 2 * reach <= width:
        found, reach = np.minimum(found[:-reach], found[reach:]), 2 * reach
    return np.minimum(found[:n], found[width - reach : width - reach + n])


def find_pieces(texts: pa.Array, length: int) -> Iterator[Pieces]:
    """The pieces of each slice of texts."""
    width = anchor_width(length)
    for data, rows, bounds, base in _slices(texts, length):
        starts = spread(bounds[:-1], np.maximum(np.diff(bounds) - length + 1, 0))
        if not len(starts):
            continue
        n = len(data)
        power = powers_to(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * power[0, :n], out=sums[1:])
        hashes = mix((sums[width:] - sums[:-width]) * power[1, : n - width + 1], 13)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (_smallest(keys, length - width + 1)[starts] & low).astype(np.int64)
        first = np.flatnonzero(turns(anchors))
        last = np.append(first[1:], len(starts)) - 1
        begin, end, anchor = starts[first], starts[last] + length, anchors[first]
        shape = ((anchor - begin) * length + (last - first)).astype(np.uint64)
        yield Pieces(
            rows[np.searchsorted(bounds, begin, side="right") - 1],
            begin - bounds[np.searchsorted(bounds, begin, side="right") - 1] + base,
            anchor - begin,
            last - first,
            hashes[anchor].view(np.int64),
            mix(((sums[end] - sums[begin]) * power[1, begin]) ^ mix(shape, 5), 17).view(np.int64),
        )


def anchor_width(length: int) -> int:
    return max(1, length // 2)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, tie, text: never null, and the same for rows that are one document."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    tie = F.pmod(F.xxhash64("text"), F.lit(1 << _TIE))
    return kept.select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), tie.alias("tie"), "text")


def _anchor_counts(rows: DataFrame, length: int) -> DataFrame:
    """anchor, n: counted inside each slice before they leave the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in find_pieces(strings(batch.column(0)), length):
                anchor, n = np.unique(found.anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], ["anchor", "n"])

    return rows.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _all_pieces(rows: DataFrame, length: int) -> DataFrame:
    """doc, place (tie and first byte), anchor, whole, before, more."""
    names = ["doc", "place", "anchor", "whole", "before", "more"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = (batch.column(k).to_numpy() for k in (0, 1))
            for p in find_pieces(strings(batch.column(2)), length):
                columns = [doc[p.row], (tie[p.row] << _AT) | p.at, p.anchor, p.whole, p.before.astype(np.int32), p.more.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return rows.select("doc", "tie", "text").mapInArrow(find, "doc long, place long, anchor long, whole long, before int, more int")


def _with_bytes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes before and behind the anchor of each wanted piece."""
    width = anchor_width(length)
    names = ["anchor", "part", "left", "right", "doc", "place", "parts"]
    piece = F.struct(F.col("place").bitwiseAND((1 << _AT) - 1).alias("at"), "before", "more", "anchor", "part", "parts")
    of_text = wanted.groupBy("doc", F.shiftright("place", _AT).alias("tie")).agg(F.collect_list(piece).alias("pieces"))
    joined = rows.join(of_text, ["doc", "tie"]).select("doc", "tie", "text", "pieces")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, tie = (batch.column(k).to_numpy() for k in (0, 1))
            lists = batch.column(3)
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            at, before, more = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            row = np.repeat(np.arange(len(batch)), counts)
            texts = strings(batch.column(2))
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :]
            data = memoryview(texts.buffers()[2])
            begin = offsets[row] + at
            left = [bytes(data[a : a + b]) for a, b in zip(begin.tolist(), before.tolist(), strict=True)]
            right = [bytes(data[a:b]) for a, b in zip((begin + before + width).tolist(), (begin + more + length).tolist(), strict=True)]
            columns = [flat.field(3), flat.field(4), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(doc[row]), pa.array((tie[row] << _AT) | at), flat.field(5)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, "anchor long, part long, left binary, right binary, doc long, place long, parts long")


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of a binary column."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def repeated_starts(group: np.ndarray, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], size: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of `size` symbols that an earlier piece of the group has, too.

    A piece is its bytes before the anchor, the anchor as one symbol (its group's), and its bytes behind it; `first` is the
    piece's rank in the order of the texts, the same for rows that are one piece. Returns the piece and the place of every string, and whether it is a repeat.
    """
    lengths = left[1] + 1 + right[1]
    begins = np.cumsum(lengths + 1) - lengths  # an end of a string before each
    symbols = np.zeros(int(begins[-1] + lengths[-1] + 1), np.int64)
    symbols[spread(begins, left[1])] = left[0].astype(np.int64) + 1
    symbols[begins + left[1]] = 257 + group
    symbols[spread(begins + left[1] + 1, right[1])] = right[0].astype(np.int64) + 1
    counts = lengths - size + 1
    starts = spread(begins, counts)
    string = np.full(len(symbols), -1, np.int64)
    string[starts] = np.arange(len(starts))
    piece = np.repeat(np.arange(len(counts)), counts)
    place = starts - begins[piece]
    order = string[suffix_array(symbols)]
    order = order[order >= 0]
    same = np.zeros(len(order), bool)
    at = left[1][piece] - place  # of the anchor, in the string
    same[1:] = (group[piece[order[1:]]] == group[piece[order[:-1]]]) & (at[order[1:]] == at[order[:-1]])
    for k in range(0, len(order), 1 << 15):
        rows = k + np.flatnonzero(same[k : k + (1 << 15)])
        one, two = (starts[order[rows - d]][:, None] + np.arange(size) for d in (0, 1))
        same[rows] = (symbols[one] == symbols[two]).all(axis=1)
    of_class = np.empty(len(order), np.int64)
    of_class[order] = np.cumsum(~same)
    earliest = np.full(len(order) + 1, len(counts))
    np.minimum.at(earliest, of_class, first[piece])
    return piece, place, first[piece] > earliest[of_class]


def _sorted_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated stretches (doc, place, n: bytes) of the first strings that others equal; and, of groups in parts, the strings
    that are left (anchor, left, right, doc, place, parts)."""
    size = length - anchor_width(length) + 1
    schema = "doc long, place long, n int, anchor long, part long, left binary, right binary, parts long"
    fields = [pa.field(a, t) for a, t in (("doc", pa.int64()), ("place", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()), ("part", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("parts", pa.int64()))]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_stream(batches, 2):
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            doc, at, parts = (table.column(c).to_numpy() for c in ("doc", "place", "parts"))
            by_text = np.lexsort((at, doc))
            first = np.empty(len(doc), np.int64)
            first[by_text] = np.cumsum(turns(doc[by_text], at[by_text]))
            left, right = _flat(table.column("left")), _flat(table.column("right"))
            piece, place, repeat = repeated_starts(group, left, right, size, first)
            found = np.flatnonzero(repeat)
            runs = np.flatnonzero(turns(piece[found], place[found] - np.arange(len(found))))
            n = np.diff(runs, append=len(found)) + length - 1
            head = found[runs]
            yield _rows(fields, [doc[piece[head]], at[piece[head]] + place[head], n.astype(np.int32)])
            rest = np.flatnonzero(~repeat & (parts[piece] > 1))
            for k in range(0, len(rest), 1 << 15):
                some = rest[k : k + (1 << 15)]
                yield _rows(fields, _strings(table, piece[some], place[some], size, doc, at, parts))

    return pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(sort, schema)


def _strings(table: pa.Table, piece: np.ndarray, place: np.ndarray, size: int, doc: np.ndarray, at: np.ndarray, parts: np.ndarray) -> list:
    """Single strings of pieces as pieces of their own, dealt by their bytes."""
    lefts, rights, anchors = table.column("left").to_pylist(), table.column("right").to_pylist(), table.column("anchor").to_numpy()
    left = [lefts[p][w:] for p, w in zip(piece.tolist(), place.tolist(), strict=True)]
    right = [rights[p][: size - 1 - len(a)] for p, a in zip(piece.tolist(), left, strict=True)]
    dealt = [xxhash.xxh3_64_intdigest(b"%d " % len(a) + a + b) % n for a, b, n in zip(left, right, parts[piece].tolist(), strict=True)]
    return [doc[piece], at[piece] + place, None, anchors[piece], np.array(dealt, np.int64), left, right, np.zeros(len(piece), np.int64)]


def _rows(fields: list[pa.Field], columns: list) -> pa.RecordBatch:
    n = len(columns[0])
    columns = columns + [None] * (len(fields) - len(columns))
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for f, c in zip(fields, columns, strict=True)], schema=pa.schema(fields))


def _once(rows: DataFrame) -> DataFrame:
    """Rows without those that are one document with another; mostly there are none, and no text is shuffled."""
    if rows.groupBy("doc", "tie").count().filter("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc", "tie").agg(F.min("text").alias("text")).select("doc", "tie", "text")


def repeated_stretches(rows: DataFrame, length: int, limit: int) -> DataFrame:
    """doc, tie, start, end: stretches of bytes that hold earlier strings; they may overlap."""
    rows = _once(rows)
    often = materialize(_anchor_counts(rows, length).filter("n > 1").select("anchor"), "anchors")
    pieces = materialize(_all_pieces(rows, length).join(often, "anchor", "left_semi"), "pieces")
    first = F.min(F.struct("doc", "place", "before", "more")).alias("first")
    firsts = materialize(pieces.groupBy("anchor", "whole").agg(first).select("anchor", "whole", "first.*"), "firsts")
    copies = pieces.join(firsts.select("doc", "place"), ["doc", "place"], "left_anti").select("doc", "place", (F.col("more") + length).alias("n"))
    sizes = firsts.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / limit)
    windows = F.when(chunks > 1, F.ceil(F.col("n") * length / (2 * limit))).otherwise(0)
    wanted = firsts.join(sizes, "anchor").withColumn("part", F.pmod("whole", chunks)).withColumn("parts", windows)
    sorted_once = materialize(_sorted_pieces(_with_bytes(rows, wanted, length), length), "sorted")
    left_over = sorted_once.filter("n IS NULL").select("anchor", "part", "left", "right", "doc", "place", "parts")
    found = sorted_once.filter("n IS NOT NULL").unionByName(_sorted_pieces(left_over, length).filter("n IS NOT NULL")).select("doc", "place", "n")
    start = F.col("place").bitwiseAND((1 << _AT) - 1)
    return copies.unionAll(found).select("doc", F.shiftright("place", _AT).alias("tie"), start.alias("start"), (start + F.col("n")).alias("end"))


def remove_repeats(docs: DataFrame, *, length: int = 100, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed stretches: start and end in bytes), kept (the bytes that are left, in order).

    `kept` need not be valid UTF-8, as a repeat may begin or end inside a character.
    """
    rows = _keyed(docs, doc_id, text)
    with scratch(docs.sparkSession) as keep:
        stretches = repeated_stretches(rows, length, limit)
        spans = stretches.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("found"))
        found = keep(spans, "stretches")
    joined = rows.join(found, ["doc", "tie"], "left").select("doc_id", "text", "found")
    names = ["doc_id", "n_bytes", "spans", "kept"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            spans, kept = [], []
            for data, pairs in zip(texts, batch.column(2).to_pylist(), strict=True):
                union: list[dict[str, int]] = []
                for p in sorted(pairs or (), key=lambda p: p["start"]):
                    if union and p["start"] <= union[-1]["end"]:
                        union[-1]["end"] = max(union[-1]["end"], p["end"])
                    else:
                        union.append(p)
                spans.append(union)
                bounds = [0, *(x for p in union for x in (p["start"], p["end"])), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)) if union else data)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
