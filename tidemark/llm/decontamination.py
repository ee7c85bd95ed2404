"""Benchmark decontamination by CGK embeddings of item-sized windows.

Words are white-space runs in lower case with letters and digits only. A document is contaminated by an item of
m words when some passage of it is within d = floor(m * (1 - similarity)) word edits of the item.

1. Embedding. A CGK random walk reads a window word by word; whether it moves on or stays depends on a hash of the
   step and the word, the same for windows and items. Two sequences at a small edit distance fall into step again
   and agree in many places. A word's bits repeat every PERIOD steps, so PERIOD steps are one map of places, and all
   windows of a text walk on together by looking that map up again and again.
2. LSH. An item of more than PART words is cut into parts of about equal length. A passage within the item's edits is
   within its own share of them on one part at least, so the parts are what windows are compared with, whatever the
   item's length; shorter items are one part. Every place of every text begins a window. Parts of 2 ** c to 2 ** (c + 1)
   words are a size class, and their
   windows' walks are sampled at PLACES steps spread over 1.75 * 2 ** c steps, which a part of the class outlasts.
   A walk gives several samplings of 2 places (3 for many items); windows that agree with a part in all places of
   one sampling, and in one place more of the walk's PLACES (their Hamming distance), are candidates. The number of
   independent walks follows from the target recall and CHANCE.
3. Candidates whose surroundings hold enough of the item's words (a count that loses nothing) are verified by the
   exact edit distance of the item to the best passage around them.

Items go to the executors in blocks of about BLOCK_CHARS, each a pass over the documents, so no size of the benchmark
is assumed. Items without words match nothing. Null and empty texts match nothing. Repeated rows give repeated
results, equal items one row each; null ids are kept. Extra columns don't matter; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, mix, pieces, spread, strings, word_hashes

SIMILARITY, RECALL = 0.8, 0.999
#: Steps after which a word's bits repeat, and sampled places of a walk.
PERIOD, PLACES = 4, 8
#: Up to so many items in a block, samplings take 2 places, else 3.
FEW_ITEMS = 500
#: Samplings of a walk, and the least chance that one of them finds a passage of exactly d edits (tests measure it).
SAMPLINGS, CHANCE = {2: 4, 3: 8}, {2: 0.5, 3: 0.38}
BLOCK_CHARS = 4_000_000
#: Words of a part at most; CHANCE holds for parts of this size.
PART = 60
MATCHES = "doc_id long, item_id long, edits int, first_word long, n_words int, passages int"


def walks(recall: float, places: int) -> int:
    """Independent walks for the target recall; a word has bits for 16."""
    return min(16, math.ceil(math.log(1 - recall) / math.log(1 - CHANCE[places])))


def size_class(m: int) -> int:
    return m.bit_length() - 1


def steps_of(c: int) -> list[int]:
    """The steps at which windows of a size class may be sampled."""
    apart = max(1, 2**c // 4)
    return [k * apart for k in range(PLACES) if k * apart <= max(1.75 * 2**c, 0 if c == 0 else 2)]


def samplings(c: int, walk: int, places: int) -> list[tuple[int, ...]]:
    """The step numbers of a walk's samplings."""
    steps = steps_of(c)
    every = list(itertools.combinations(steps, min(places, len(steps))))
    order = np.random.default_rng([walk, c]).permutation(len(every))
    return [every[k] for k in order[: SAMPLINGS[places]]]


class Texts:
    """Words of many rows, ready for walks: a zero word (where walks end) after each row, and `lead` words that occur
    nowhere else before it, so that a passage whose beginning a row lacks has windows, too."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, lead: int = 0):
        rows, n = len(offsets) - 1, np.diff(offsets)
        self.begins = offsets[:-1] + np.arange(rows) * (lead + 1)
        self.starts = self.begins + lead
        self.ends = self.starts + n
        self.words = np.zeros(len(words) + rows * (lead + 1), np.uint64)
        self.words[spread(self.starts, n)] = words
        self.words[spread(self.begins, np.full(rows, lead))] = np.tile(mix(np.arange(lead, dtype=np.uint64), 77), rows)
        self.code = (self.words >> np.uint64(32)).astype(np.uint32)
        self.bits = mix(self.words, 1)

    def walk(self, number: int, steps: list[int]) -> dict[int, np.ndarray]:
        """The words that all windows' walks read after the given steps."""
        nibble = _NIBBLES[number % PERIOD][((self.bits >> np.uint64(4 * number)) & np.uint64(15)).astype(np.uint8)]
        nibble[self.ends] = 0
        part = [np.arange(len(self.words))]
        for j in range(PERIOD):
            part.append(part[-1] + ((nibble.take(part[-1]) if j else nibble) >> j & 1))
        rounds, out = {0: part[0]}, {}
        for s in steps:
            a, i = divmod(s, PERIOD)
            for k in range(max(rounds) + 1, a + 1):
                rounds[k] = part[PERIOD].take(rounds[k - 1]) if k > 1 else part[PERIOD]
            at = rounds[a] if not i else part[i].take(rounds[a]) if a else part[i]
            out[s] = self.code.take(at) if s else self.code
        return out


#: The bits of a word by its nibble; a word without a bit gets one, so that every walk goes on.
_NIBBLES = [np.array([1 << k, *range(1, 16)], np.uint8) for k in range(PERIOD)]


def sampled(read: dict[int, np.ndarray], steps: tuple[int, ...]) -> np.ndarray:
    """One hash of the words read at the given steps."""
    key = read[steps[0]] * np.uint32(0x9E3779B1)
    for k, s in enumerate(steps[1:]):
        if k:
            key ^= key >> np.uint32(15)
        key ^= read[s]
        key *= np.uint32(0x85EBCA77)  # leaves its leading bits mixed, which flags_of looks at
    return key


@dataclass
class Items:
    """A block of items: words one after another, offsets, edits allowed; their parts (bounds in the words, item, place in
    it); and the LSH tables of the parts' samplings."""

    ids: list
    words: np.ndarray
    offsets: np.ndarray
    edits: np.ndarray
    part_offsets: np.ndarray
    part_item: np.ndarray
    part_begin: np.ndarray
    places: int
    n_walks: int
    tables: dict[tuple[int, int, tuple[int, ...]], tuple[np.ndarray, np.ndarray]]
    sketches: list[dict[int, np.ndarray]]  # of each walk: the words that the items read at each step

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], similarity: float, recall: float) -> Items:
        words, offsets, _ = word_hashes(strings(pa.array([t for _, t in rows], pa.string())))
        m = np.diff(offsets)
        parts = np.maximum(-(-m // PART), 1)
        item = np.repeat(np.arange(len(m)), parts)
        begin = m[item] * (np.arange(len(item)) - np.repeat(np.cumsum(parts) - parts, parts)) // parts[item]
        part_offsets = np.append(offsets[item] + begin, len(words))
        places = 2 if len(item) <= FEW_ITEMS else 3
        edits = np.floor(m * (1 - similarity) + 1e-9).astype(np.int64)
        out = cls([i for i, _ in rows], words, offsets, edits, part_offsets, item, begin, places, walks(recall, places), {}, [])
        texts = Texts(words, part_offsets)
        classes = np.array([size_class(int(n)) for n in np.diff(part_offsets)], np.int64)
        for w in range(out.n_walks):
            out.sketches.append({s: x[texts.starts] for s, x in texts.walk(w, out.steps()).items()})
            for c in out.classes():
                mine = np.flatnonzero(classes == c)
                for steps in samplings(c, w, places):
                    key = sampled({s: out.sketches[w][s][mine] for s in steps}, steps)
                    order = np.argsort(key, kind="stable")
                    out.tables[w, c, steps] = key[order], mine[order]
        return out

    def classes(self) -> list[int]:
        return sorted({size_class(int(n)) for n in np.diff(self.part_offsets) if n})

    def steps(self) -> list[int]:
        return sorted({s for c in self.classes() for s in steps_of(c)})

    def lead(self) -> int:
        """Words of its beginning that a row may lack of a part."""
        return int((self.edits[self.part_item] * np.diff(self.part_offsets) // np.maximum(np.diff(self.offsets)[self.part_item], 1)).max(initial=0))

    def words_of(self, j: int) -> np.ndarray:
        return self.words[self.offsets[j] : self.offsets[j + 1]]


def flags_of(keys: np.ndarray) -> tuple[np.ndarray, np.uint32]:
    """A table that says which leading bits of a 32-bit key occur at all, and the shift to them."""
    bits = min(24, max(12, (64 * len(keys)).bit_length()))
    flags = np.zeros(1 << bits, bool)
    flags[keys >> np.uint32(32 - bits)] = True
    return flags, np.uint32(32 - bits)


class Matcher:
    """What a task keeps of a block of items."""

    def __init__(self, items: Items):
        self.items = items
        self.flags = {k: flags_of(t[0]) for k, t in items.tables.items()}
        item = np.repeat(np.arange(len(items.ids)), np.diff(items.offsets))
        self.held = flags_of(self._held(item, items.words))

    @staticmethod
    def _held(item: np.ndarray, words: np.ndarray) -> np.ndarray:
        key = ((words >> np.uint64(32)).astype(np.uint32) ^ item.astype(np.uint32)) * np.uint32(0x9E3779B1)
        return (key ^ key >> np.uint32(15)) * np.uint32(0x85EBCA77)

    def candidates(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Parts and window starts (places in texts) that agree in a sampling and one place more, once each."""
        found = [np.empty(0, np.int64)]
        for w in range(self.items.n_walks):
            read = texts.walk(w, self.items.steps())
            for c in self.items.classes():
                pairs = [np.empty(0, np.int64)]
                for steps in samplings(c, w, self.items.places):
                    keys, item = self.items.tables[w, c, steps]
                    own = sampled(read, steps)
                    flags, shift = self.flags[w, c, steps]
                    maybe = np.flatnonzero(flags.take(own >> shift))
                    own = own[maybe]
                    left = np.searchsorted(keys, own, "left")
                    many = np.searchsorted(keys, own, "right") - left
                    pairs.append((item[spread(left, many)] << 40) + np.repeat(maybe, many))
                pairs = np.unique(np.concatenate(pairs))
                if len(steps_of(c)) == PLACES:
                    item, start = pairs >> 40, pairs & ((1 << 40) - 1)
                    agree = sum((read[s][start] == self.items.sketches[w][s][item]).astype(np.int8) for s in steps_of(c))
                    pairs = pairs[agree > self.items.places]
                found.append(pairs)
        pairs = np.unique(np.concatenate(found))
        return pairs >> 40, pairs & ((1 << 40) - 1)

    def regions(self, texts: Texts, part: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """Item, row, first place and width of the surroundings to verify; near starts share one."""
        item = self.items.part_item[part]
        m, d = np.diff(self.items.offsets)[item], self.items.edits[item]
        row = np.searchsorted(texts.begins, start, "right") - 1
        apart = d // 2 + 1
        # a window of a part may be as far from the part's place as the part has edits
        more = np.where(m > PART, self.items.lead(), 0)
        inside = (start - self.items.part_begin[part] - texts.starts[row]) // apart * apart
        first = texts.starts[row] + inside
        once = np.unique((item << 40) + (1 << 39) + first, return_index=True)[1]
        item, row, inside, m, d, more = (x[once] for x in (item, row, inside, m, d, more))
        return item, row, texts.starts[row] + inside - d - more, m + 3 * d + 2 * more + d // 2

    def holding(self, texts: Texts, item: np.ndarray, row: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Which regions hold as many words of their item as a passage within its edits must have."""
        flags, shift = self.held
        need = np.diff(self.items.offsets)[item] - self.items.edits[item]
        out = np.zeros(len(item), bool)
        for lo in range(0, len(item), 20_000):
            part = slice(lo, lo + 20_000)
            a = np.maximum(first[part], texts.starts[row[part]])
            n = np.maximum(np.minimum(first[part] + width[part], texts.ends[row[part]]) - a, 0)
            hit = flags[self._held(np.repeat(item[part], n), texts.words[spread(a, n)]) >> shift]
            total = np.concatenate([[0], np.cumsum(hit)])
            end = np.cumsum(n)
            out[part] = total[end] - total[end - n] >= need[part]
        return out

    def verify(self, texts: Texts, item: np.ndarray, row: np.ndarray, first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, item, edits and passage end (place in texts) of the regions with a passage within the item's edits."""
        out = [(np.empty(0, np.int64),) * 4]
        for j in np.unique(item).tolist():
            mine = np.flatnonzero(item == j)
            for lo in range(0, len(mine), 4096):
                k = mine[lo : lo + 4096]
                at = first[k][:, None] + np.arange(int(width[k[0]]))
                inside = (at >= texts.starts[row[k]][:, None]) & (at < texts.ends[row[k]][:, None])
                regions = np.where(inside, texts.words[np.clip(at, 0, len(texts.words) - 1)], np.uint64(0))
                edits, end = edit_distances(self.items.words_of(j), regions)
                good = edits <= self.items.edits[j]
                out.append((row[k][good], np.full(good.sum(), j), edits[good], (first[k] + end)[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def matches(self, words: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list]:
        """(row, item) -> edits, first word and end of the best passage, and separate passages."""
        texts = Texts(words, offsets, self.items.lead())
        regions = self.regions(texts, *self.candidates(texts))
        regions = tuple(x[self.holding(texts, *regions)] for x in regions)
        best: dict[tuple[int, int], list] = {}
        for r, j, e, stop in sorted(zip(*(x.tolist() for x in self.verify(texts, *regions)), strict=True), key=lambda x: (x[0], x[1], x[3])):
            stop -= int(texts.starts[r])
            m = int(self.items.offsets[j + 1] - self.items.offsets[j])
            seen = best.setdefault((r, j), [e, stop, 1, stop])
            if stop - seen[3] >= m:  # another passage
                seen[2] += 1
                seen[3] = stop
            if e < seen[0]:
                seen[:2] = [e, stop]
        return {(r, j): [e, max(stop - int(self.items.offsets[j + 1] - self.items.offsets[j]), 0), n] for (r, j), (e, stop, n, _) in best.items()}


def edit_distances(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of the item to the best passage of each region (rows of equal length), and that passage's end."""
    n = regions.shape[1]
    row = np.zeros((len(regions), n + 1), np.int32)
    ramp = np.arange(n + 1, dtype=np.int32)
    for i, word in enumerate(item, 1):
        step = np.full_like(row, i)
        step[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (regions != word))
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
    return row.min(axis=1), row.argmin(axis=1)


def find(docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: the best passage's edits, its first word and length (in
    words of the document), and how many separate passages there are."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = []
    for b in range(blocks):  # the driver holds one block at a time
        items = Items.of([(r.id, r.text) for r in rows.filter(F.col("block") == b).collect()], similarity, recall)
        found = _find_block(base, items)
        parts.append(found if blocks == 1 else materialize(found, "contaminated"))
    return reduce(DataFrame.unionByName, parts)


def _find_block(docs: DataFrame, items: Items) -> DataFrame:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items)
        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi in pieces(texts):
                words, offsets, _ = word_hashes(texts[lo:hi])
                found = matcher.matches(words, offsets) if len(words) and items.tables else {}
                if not found:
                    continue
                keys, values = list(found), list(found.values())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([lo + r for r, _ in keys])),
                        pa.array([items.ids[j] for _, j in keys], pa.int64()),
                        pa.array([v[0] for v in values], pa.int32()),
                        pa.array([v[1] for v in values], pa.int64()),
                        pa.array([int(items.offsets[j + 1] - items.offsets[j]) for _, j in keys], pa.int32()),
                        pa.array([v[2] for v in values], pa.int32()),
                    ],
                    ["doc_id", "item_id", "edits", "first_word", "n_words", "passages"],
                )

    return docs.mapInArrow(lean(match), MATCHES)
