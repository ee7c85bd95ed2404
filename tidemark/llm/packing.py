"""Best-fit packing by large-item matching.

Documents are cut into pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most
`capacity` rows) reaches the driver, which decides kinds of sequences and how many of each:

1. pieces above a third of the capacity, longest first, are matched greedily with the longest other one
   that still fits, so at most two of them share a sequence;
2. smaller pieces, longest first, go to the tightest gap that takes them; new sequences open when no gap does.

Pieces then take their place by their rank among the pieces of their length. Ranks come from windows over
(length, salt), so a length that a third of all pieces have is spread over many tasks; the salt comes from the
row and the piece's number, so one long document's pieces are spread, too.

Null and empty texts hold only the end id. Rows that repeat are packed each by itself; null doc_ids are
kept. Only the two named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, strings

SALTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places for all pieces of each length: rows (length, first rank, end rank, first sequence, per sequence, offset).

    Work grows with the number of distinct lengths, not of pieces.
    """
    kinds: list[list] = []  # [sequences of this kind, gap, [(length, pieces a sequence), ...]]
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1
        b = large[i] if i >= 0 else None
        if b is None:
            many, items = left[a], [(a, 1)]
        elif b == a and left[a] < 2:
            smaller = large[i - 1] if i else None
            b = smaller
            many, items = 1, [(a, 1)] + ([(b, 1)] if b else [])
        elif b == a:
            many, items = left[a] // 2, [(a, 2)]
        else:
            many, items = min(left[a], left[b]), [(a, 1), (b, 1)]
        kinds.append([many, capacity - sum(n * q for n, q in items), items])
        for n, q in items:
            left[n] -= many * q
            if not left[n]:
                large.remove(n)
    gaps = sorted((k[1], i) for i, k in enumerate(kinds))
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[s]
        while c:
            at = bisect_left(gaps, (s, -1))
            if at == len(gaps):
                q = min(c, capacity // s)
                kinds.append([c // q if q == capacity // s else 1, capacity, []])
                insort(gaps, (capacity, len(kinds) - 1))
                continue
            gap, i = gaps.pop(at)
            many, _, items = kinds[i]
            q = gap // s
            full = min(many, c // q)
            if not full:  # the last pieces of this length: one sequence takes them, the others keep their gap
                full, q = 1, c
            if full < many:
                kinds.append([many - full, gap, list(items)])
                insort(gaps, (gap, len(kinds) - 1))
            kinds[i] = [full, gap - q * s, [*items, (s, q)]]
            insort(gaps, (gap - q * s, i))
            c -= full * q
    rank: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for many, _, items in kinds:
        offset = 0
        for n, q in items:
            rows.append((n, rank[n], rank[n] + many * q, sequence, q, offset))
            rank[n] += many * q
            offset += n * q
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def cut(docs: DataFrame, vocabulary: str, capacity: int, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents, with the ids themselves if keep_ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import PIECE_CHARS, encoder

        for batch in batches:
            texts, doc_ids = strings(batch.column(1)), batch.column(0)
            salts = batch.column(2)
            for lo, hi in pieces(texts, PIECE_CHARS):
                ids, offsets = encoder(vocabulary).encode(texts[lo:hi])
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                n = np.diff(offsets) + 1
                each = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), each)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                at = (np.cumsum(n) - n)[row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                rows = pa.array(row + lo)
                columns = [doc_ids.take(rows), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array((salts.to_numpy()[row + lo] + piece) % SALTS, pa.int32())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    salt = F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")), F.lit(SALTS)).cast("int")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), salt.alias("salt")).mapInArrow(encode, schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, **kwargs) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece (and its ids with keep_ids)."""
    cut_pieces = materialize(cut(docs, vocabulary, capacity, **kwargs), "pieces")
    # at most capacity x SALTS rows, whatever the number of documents
    groups = sorted((r.length, r.salt, r.n) for r in cut_pieces.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())
    counts: dict[int, int] = {}
    first = np.zeros((capacity + 1, SALTS), np.int64)
    for length, salt, n in groups:
        first[length, salt] = counts.get(length, 0)
        counts[length] = counts.get(length, 0) + n
    places = plan(counts, capacity)
    keys = (places[:, 0] << 48) + places[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            length, salt, nth = (column[n].to_numpy(zero_copy_only=False) for n in ("length", "salt", "nth"))
            rank = first[length, salt] + nth - 1
            row = places[np.searchsorted(keys, (length.astype(np.int64) << 48) + rank, "right") - 1]
            inside = rank - row[:, 1]
            column["sequence_id"] = pa.array(row[:, 3] + inside // row[:, 4])
            column["offset"] = pa.array(row[:, 5] + inside % row[:, 4] * length)
            yield pa.RecordBatch.from_arrays([column[n] for n in out], out)

    kept = [n for n in cut_pieces.columns if n != "salt"]
    out = [*kept, "sequence_id", "offset"]
    types = dict(cut_pieces.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    ranked = cut_pieces.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")).cast("long"))
    return ranked.mapInArrow(place, ", ".join(f"`{n}` {types[n]}" for n in out))
