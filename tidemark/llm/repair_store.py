"""Token-ID output with Re-Pair grammar compression.

Documents go to shards by ranges of doc_id; a shard is a run of blocks. In each block frequent id pairs
are replaced, again and again, by new symbols (nonterminals); the block stores the rules, their
expansion lengths and the rest sequence, so any slice of any document can be decoded by itself.

A round replaces many pairs at once: every occurrence of a frequent pair that is more frequent than the
pairs overlapping it. Only places whose pair may be frequent are looked at: a pair of old symbols only gets
rarer, so places drop out as their pair is found to be rare, and come back where a neighbour is replaced.
Rounds go on until no pair of a block occurs MIN_COUNT times.

Rest symbols, rules and expansion lengths take as many bits as the largest needs: the low 16 bits (or 8) of each, then one
bit plane for each higher bit, so a single one is found without reading those before it.

Null texts are empty documents (only the end id). Null doc_ids are kept and come first. Repeated doc_ids
are separate documents in the order of a hash of their text. Only the two named columns are read. An empty
table gives no blocks. A document longer than a block is a block by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pieces, spread, strings

MAGIC = b"RPR2"
#: Ids of one block, unless a document alone has more.
BLOCK_IDS = 1_000_000
#: A pair is frequent from so many occurrences in its block. A rule costs two symbols and an expansion length, which is
#: shorter than a symbol, and at least half of its pair's places are replaced: so each rule saves what it costs.
MIN_COUNT = 6
#: Bits of the table that counts pairs; of two pairs on one slot, one waits for a later round.
TABLE_BITS = 18

BLOCKS = "shard int, block int, n_docs long, n_tokens long, n_symbols long, data binary"


def compress(ids: np.ndarray, lengths: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rest sequence, each document's symbols, rules (left, right) and the rules of each round."""
    n, size = len(ids), 1 << TABLE_BITS
    seq = ids.astype(np.uint32)
    last = np.zeros(n, bool)
    last[np.cumsum(lengths) - 1] = True  # every document has its end id, so none is empty
    following, preceding = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    alive = np.ones(n, bool)
    active = np.flatnonzero(~last).astype(np.int32)  # places whose pair with the next symbol may be frequent
    rules, rounds, symbol = [], [], first_symbol
    while len(active):
        key = (seq[active].astype(np.uint64) << np.uint64(32)) | seq[following[active]]
        slot = _slots(key, 2 * len(rounds))
        busy = np.bincount(slot, minlength=size)[slot] >= MIN_COUNT
        active, key = active[busy], key[busy]
        slot = _slots(key, 2 * len(rounds) + 1)
        owner = np.zeros(size, np.uint64)
        owner[slot] = key
        counted = owner[slot] == key
        counts = np.bincount(slot[counted], minlength=size)
        often = np.flatnonzero(counts >= MIN_COUNT)
        rank = np.zeros(size, np.int32)  # frequent pairs by count, from 1
        rank[often[np.argsort(counts[often], kind="stable")]] = np.arange(1, len(often) + 1)
        here = np.where(counted, rank[slot], 0)
        linked = np.zeros(len(active) + 1, bool)  # whether a place's pair overlaps that of the place before it in the list
        linked[1:-1] = following[active[:-1]] == active[1:]
        before, after = np.where(linked[:-1], np.roll(here, 1), 0), np.where(linked[1:], np.roll(here, -1), 0)
        first = here != before
        place = np.arange(len(here), dtype=np.int32)
        run = place - np.maximum.accumulate(np.where(first, place, 0))  # a run: one pair again and again, as in aaaa
        taken = np.flatnonzero((here > 0) & (run % 2 == 0) & (~first | (here > before)) & (here >= after))
        # a pair that others take most places of waits until they are done; half of the most frequent one's are always left
        used = np.bincount(slot[taken], minlength=size) >= MIN_COUNT // 2
        taken = taken[used[slot[taken]]]
        used = np.flatnonzero(used)
        number = np.zeros(size, np.uint32)
        number[used] = symbol + np.arange(len(used))
        pairs = owner[used]
        rules.append(np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)]).astype(np.uint32))
        rounds.append(len(used))
        symbol += len(used)
        left = active[taken]
        right = following[left]
        beyond = following[right]
        seq[left], last[left] = number[slot[taken]], last[right]
        alive[right] = False
        following[left] = beyond
        preceding[beyond[beyond < n]] = left[beyond < n]
        look = np.zeros(n, bool)
        look[active[(here > 0) | ~counted]] = True
        look[left] = True
        back = preceding[left]
        look[back[back >= 0]] = True
        active = np.flatnonzero(look & alive & ~last).astype(np.int32)
    ends = np.cumsum(alive)[np.flatnonzero(last & alive)]
    return seq[alive], np.diff(ends, prepend=0), np.concatenate(rules, axis=1) if rules else np.zeros((2, 0), np.uint32), np.array(rounds, np.uint32)


def _slots(key: np.ndarray, seed: int) -> np.ndarray:
    return (((key ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def expansion_lengths(rules: np.ndarray, rounds: np.ndarray, first_symbol: int) -> np.ndarray:
    out, lo = np.ones(rules.shape[1], np.uint32), 0
    for n in rounds:
        part = rules[:, lo : lo + n].astype(np.int64) - first_symbol
        out[lo : lo + n] = np.where(part < 0, 1, out[np.maximum(part, 0)]).sum(axis=0)
        lo += n
    return out


def pack_numbers(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32 in as many bits as the largest needs."""
    numbers = numbers.astype(np.uint32)
    bits = int(numbers.max(initial=0)).bit_length()
    low = 16 if bits > 8 else 8
    planes = [np.packbits((numbers >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(low, bits)]
    return struct.pack("<IB", len(numbers), bits) + numbers.astype(f"<u{low // 8}").tobytes() + b"".join(planes)


def unpack_numbers(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers packed at a place, and the place after them."""
    n, bits = struct.unpack_from("<IB", data, at)
    low, at = (16 if bits > 8 else 8), at + 5
    out = np.frombuffer(data, f"<u{low // 8}", n, at).astype(np.int64)
    at += n * low // 8
    for k in range(low, bits):
        plane = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
        out |= np.unpackbits(plane, count=n).astype(np.int64) << k
        at += len(plane)
    return out, at


def pack_block(doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray, first_symbol: int = 65536) -> tuple[bytes, int]:
    seq, symbols, rules, rounds = compress(ids, lengths, first_symbol)
    documents = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    numbers = lengths, symbols, rounds, rules[0], rules[1], expansion_lengths(rules, rounds, first_symbol), seq
    head = MAGIC + struct.pack("<2I", first_symbol, len(lengths))
    return head + b"".join(x.tobytes() for x in documents) + b"".join(pack_numbers(x) for x in numbers), len(seq)


class Block:
    """A stored block: whole() gives all ids, slice() decodes only the symbols that a slice touches."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a Re-Pair block")
        self.first, n_docs = struct.unpack_from("<2I", data, 4)
        null, doc_ids = np.frombuffer(data, np.uint8, n_docs, 12), np.frombuffer(data, "<i8", n_docs, 12 + n_docs)
        self.doc_ids = pa.array(doc_ids, pa.int64(), mask=null.astype(bool))
        numbers, at = [], 12 + 9 * n_docs
        for _ in range(7):
            one, at = unpack_numbers(data, at)
            numbers.append(one)
        self.lengths, symbols, rounds, left, right, self.expansions, self.seq = numbers
        rules = np.stack([left, right])
        self.symbol_starts = np.concatenate([[0], np.cumsum(symbols)])
        self.pool_starts = np.cumsum(self.expansions) - self.expansions
        self.pool = np.zeros(int(self.expansions.sum()), np.uint32)
        lo = 0
        for n in rounds.tolist():  # the rules of a round use only symbols of the rounds before it
            both = rules[:, lo : lo + n].T.reshape(-1)
            n_out = self.expansions[lo : lo + n].sum()
            start = self.pool_starts[lo] if n else 0
            self.pool[start : start + n_out] = self._expand(both)
            lo += n

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols - self.first
        if not len(self.expansions):
            return symbols.astype(np.uint32)
        is_rule = rule >= 0
        rule = np.where(is_rule, rule, 0)
        n = np.where(is_rule, self.expansions[rule], 1)
        out = np.repeat(symbols.astype(np.uint32), n)
        inner = np.repeat(is_rule, n)
        out[inner] = self.pool[spread(self.pool_starts[rule[is_rule]], n[is_rule])]
        return out

    def whole(self) -> np.ndarray:
        return self._expand(self.seq)

    def slice(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of the block's doc-th document, found by its symbols' expansion lengths."""
        seq = self.seq[self.symbol_starts[doc] : self.symbol_starts[doc + 1]]
        rule = seq - self.first
        n = np.where(rule >= 0, self.expansions[np.maximum(rule, 0)], 1) if len(self.expansions) else np.ones(len(seq), np.int64)
        ends = np.cumsum(n)
        stop = min(stop, int(self.lengths[doc]))
        if start >= stop:
            return np.empty(0, np.uint32)
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (ends[lo] - n[lo])
        return self._expand(seq[lo:hi])[skip : skip + stop - start]


def write_blocks(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encode, compress and store all documents in ascending doc_id order; the stored blocks, read back."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import PIECE_CHARS, encoder

        shard, number = TaskContext.get().partitionId(), 0
        held_ids, held_lengths, held_docs, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            ids, lengths = np.concatenate(held_ids), np.concatenate(held_lengths)
            data, n_symbols = pack_block(pa.concat_arrays(held_docs), ids, lengths)
            row = [[shard], [number], [len(lengths)], [len(ids)], [n_symbols], [data]]
            number, held = number + 1, 0
            for x in (held_ids, held_lengths, held_docs):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for batch in batches:
            texts, doc_ids = strings(batch.column(1)), batch.column(0)
            for lo, hi in pieces(texts, PIECE_CHARS):
                ids, offsets = encoder(vocabulary).encode(texts[lo:hi])
                ids = np.insert(ids, offsets[1:], end_id)
                lengths = np.diff(offsets) + 1
                bounds = np.cumsum(lengths)
                a = 0
                while a < hi - lo:
                    before = bounds[a - 1] if a else 0
                    b = int(np.searchsorted(bounds, before + BLOCK_IDS - held, "right"))
                    if b == a and held:  # the next document does not fit beside what is held
                        yield flush()
                        continue
                    b = max(a + 1, b)
                    held_ids.append(ids[before : bounds[b - 1]])
                    held_lengths.append(lengths[a:b])
                    held_docs.append(doc_ids[lo + a : lo + b])
                    held += int(bounds[b - 1] - before)
                    if held >= BLOCK_IDS or b < hi - lo:
                        yield flush()
                    a = b
        if held:
            yield flush()

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    # the hash spreads texts of one id, or of none, over tasks
    ordered = base.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    return materialize(ordered.mapInArrow(write, BLOCKS), "repair", compression="zstd")


def read_documents(blocks: DataFrame) -> DataFrame:
    """Decode every stored block: doc_id, place in the order, start, n_tokens, ids_crc32, and the block it lies in."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                block = Block(data)
                ids = memoryview(block.whole().astype("<u4").tobytes())
                ends = np.cumsum(block.lengths)
                starts = ends - block.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()), block.doc_ids, pa.array(starts), pa.array(block.lengths), pa.array(crc, pa.int64())],
                    ["shard", "block", "doc_id", "place", "n_tokens", "ids_crc32"],
                )

    decoded = blocks.select("shard", "block", "data").mapInArrow(read, "shard int, block int, doc_id long, place long, n_tokens long, ids_crc32 long")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_shard")).join(shards, "shard")
    return decoded.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("in_shard") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
