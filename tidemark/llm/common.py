"""What the operators of this subpackage share: tables on shared storage and word streams."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, discard, materialize, scratch, shared_dir  # noqa: F401

#: Code points handled at once inside a task; a longer text is one piece by itself.
PIECE_CHARS = 500_000

_NOT_WORD, _SPACE = re.compile(r"[\W_]+"), re.compile(r"\s")


#: Rows of texts that a Python worker gets at once; Spark's own default makes batches of tens of megabytes.
BATCH_ROWS = 2048


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; Arrow batches of the session get fewer rows, unless it has a number of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for a Python worker that served other stages before: what tokenizers remember there goes first, and at the end of
    the task its memory goes back to the system. Workers outlive stages, and an executor may hold several."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokens := sys.modules.get(f"{__package__}.tokens"):
            tokens._encoders.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return alone


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(texts: pa.Array, limit: int = PIECE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` code points each (one row at least)."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def normal_word(word: str) -> str:
    """Lower case, letters and digits only. A word is a run of non-white-space; empty results are no words."""
    return _NOT_WORD.sub("", word.lower().replace("ς", "σ"))


class _Characters:
    """What each code point is to a word: white space, nothing, or a letter or digit with its lower case."""

    SPACE, NOTHING, LETTER = 0, 1, 2

    def __init__(self):
        self.kind = np.full(0x110000, self.NOTHING, np.uint8)
        self.value = np.zeros(0x110000, np.uint64)
        self.known = np.zeros(0x1100, bool)

    def learn(self, codes: np.ndarray) -> None:
        """Fill the pages of 256 code points that occur."""
        pages = np.flatnonzero(np.bincount(codes >> np.uint32(8), minlength=0x1100)[:0x1100] > 0)
        for page in pages[~self.known[pages]].tolist():
            for c in range(page << 8, page + 1 << 8):
                if chr(c).isspace():
                    self.kind[c] = self.SPACE
                elif low := normal_word(chr(c)):
                    self.kind[c], self.value[c] = self.LETTER, ord(low[0])
            part = slice(page << 8, page + 1 << 8)
            self.value[part] = mix(self.value[part], 9)
            self.known[page] = True


_characters = _Characters()
#: Odd multiplier of the words' polynomial hashes, and its inverse modulo 2 ** 64.
_BASE = 0xD1342543DE82EF95
_powers = np.ones((2, 1), np.uint64)
#: Letters from which a word is hashed on its own: a polynomial modulo 2 ** 64 has known collisions for long periodic words.
_LONG_WORD = 256


def powers_to(n: int) -> np.ndarray:
    """Powers of the base and of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        steps = np.repeat(np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64), n, axis=1)
        steps[:, 0] = 1
        _powers = np.multiply.accumulate(steps, axis=1)
    return _powers


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass(frozen=True)
class WordTable:
    """The words of some texts: hashes, row offsets, places among the text's runs of non-white-space, and the characters of
    the text at which these runs begin and end."""

    hashes: np.ndarray
    offsets: np.ndarray
    places: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def char_slices(texts: list[str], width: int, limit: int = PIECE_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Portions (numbers of texts, strings) in which every run of `width` characters of every text stands once."""
    rows, parts, total = [], [], 0
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - width + 1, 1), limit):
            part = t[a : a + limit + width - 1]
            if parts and total + len(part) > limit:
                yield rows, parts
                rows, parts, total = [], [], 0
            rows.append(k)
            parts.append(part)
            total += len(part)
    if parts:
        yield rows, parts


def _cut_at_space(text: str, limit: int) -> Iterator[tuple[int, str]]:
    """A text in parts of about `limit` characters that begin with white space, and where they begin."""
    at = 0
    while at < len(text):
        space = _SPACE.search(text, at + limit)
        end = space.start() if space else len(text)
        yield at, text[at:end]
        at = end


def word_table(texts: pa.Array) -> WordTable:
    """All words of all texts; a long text goes in parts, which white space separates."""
    rows = texts.to_pylist()
    if max(map(len, rows), default=0) <= 2 * PIECE_CHARS:
        return _word_table(rows)[0]
    found: list[list[np.ndarray]] = []
    for row in rows:
        runs, parts = 0, []
        for at, part in _cut_at_space(row, PIECE_CHARS):
            table, n = _word_table([part])
            parts.append((table.hashes, table.places + runs, table.starts + at, table.ends + at))
            runs += n
        found.append([np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in (np.uint64, np.int64, np.int64, np.int64)])
    hashes, places, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return WordTable(hashes, np.cumsum([0, *(len(f[0]) for f in found)]), places, starts, ends)


def _word_table(rows: list[str]) -> tuple[WordTable, int]:
    """The words of the rows and how many runs of non-white-space they have. Everything is array arithmetic over the code
    points."""
    codes = code_points([t + "\n" for t in rows])
    row_starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) + 1)])
    _characters.learn(codes)
    kind = _characters.kind[codes]
    inside = kind != _Characters.SPACE
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(codes) else np.empty(0, np.int64)
    turns = np.concatenate([[0], turns]) if len(codes) and inside[0] else turns
    starts, ends = turns[::2], turns[1::2]  # of runs; the last character is white space
    is_letter = kind == _Characters.LETTER
    letters = np.flatnonzero(is_letter)
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(is_letter, out=before[1:])
    first, last = before[starts], before[ends]
    power = powers_to(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(_characters.value[codes[letters]] * power[0, : len(letters)], dtype=np.uint64, out=sums[1:])
    real = last > first
    runs_before = np.searchsorted(starts, row_starts)
    row = np.repeat(np.arange(len(rows)), np.diff(runs_before))
    places = np.arange(len(starts)) - runs_before[row]
    offsets = np.concatenate([[0], np.cumsum(real)])[runs_before]
    first, last, row = first[real], last[real], row[real]
    hashes = mix((sums[last] - sums[first]) * power[1, first], 13)
    for k in np.flatnonzero(last - first > _LONG_WORD).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(_characters.value[codes[letters[first[k] : last[k]]]].tobytes())
    return WordTable(hashes, offsets, places[real], starts[real] - row_starts[row], ends[real] - row_starts[row]), len(starts)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, row offsets, and each word's place among the text's white-space runs."""
    found = word_table(texts)
    return found.hashes, found.offsets, found.places


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), keyed by seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words that stay inside one row, and the row offsets."""
    n = len(words) - width + 1
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    out = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0 or not out[-1]:
        return np.empty(0, np.uint64), out
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ words[k : k + n]) * np.uint64(0x9DDFEA08EB382D69)
        h ^= h >> np.uint64(29)
    starts = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
    return mix(h[starts], width), out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of range(s, s + n) for each pair."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])


def group_stream(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 8192) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream sorted by its first `keys` columns, of about `rows` rows, and the groups' bounds in
    each."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= rows:
            table = pa.concat_tables(held).combine_chunks()
            bounds = _bounds(table, keys)
            yield from _in_portions(table, bounds[:-1], rows)
            held = [table.slice(int(bounds[-2]))]
    if held:
        table = pa.concat_tables(held).combine_chunks()
        yield from _in_portions(table, _bounds(table, keys), rows)


def _in_portions(table: pa.Table, bounds: np.ndarray, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    at = 0
    while at < len(bounds) - 1:
        end = min(len(bounds) - 1, max(at + 1, int(np.searchsorted(bounds, bounds[at] + rows))))
        yield table.slice(int(bounds[at]), int(bounds[end] - bounds[at])), bounds[at : end + 1] - bounds[at]
        at = end


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows - 1, bool)
    for k in range(keys):
        column = table.column(k)
        new |= pc.not_equal(column[1:], column[:-1]).to_numpy()
    return np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])


def pairs_in_groups(bounds: np.ndarray, limit: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of rows of one group, in portions: the rows a distance apart, one distance after the other."""
    end = np.repeat(bounds[1:], np.diff(bounds))
    i, apart = np.arange(bounds[-1]), 0
    left, right, n = [], [], 0
    while len(i):
        apart += 1
        i = i[i + apart < end[i]]
        left.append(i)
        right.append(i + apart)
        n += len(i)
        if n >= limit or not len(i):
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, tag: str) -> DataFrame:
    """id, home: every vertex of edges (a, b) and one vertex of its component, the same for all of them.

    Each round maps a vertex to the smallest of itself and its neighbours and contracts the edges, until none is left;
    each round is a table on shared storage. Nothing is collected; a hot vertex is pre-aggregated before the shuffle.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{tag}-edges")
    total = None
    while True:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("home")).unionAll(edges.select(F.col("b").alias("id"), F.col("a").alias("home")))
        step = materialize(ends.groupBy("id").agg(F.min("home").alias("home")).select("id", F.least("id", "home").alias("home")), f"{tag}-step")
        if total is None:
            total = step
        else:
            following = step.select(F.col("id").alias("home"), F.col("home").alias("next"))
            total = materialize(total.join(following, "home", "left").select("id", F.coalesce("next", "home").alias("home")), f"{tag}-homes")
        to = lambda c: step.select(F.col("id").alias(c), F.col("home").alias(f"{c}_home"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a_home", "b_home").alias("a"), F.greatest("a_home", "b_home").alias("b"))
        edges = materialize(moved.filter("a < b").distinct(), f"{tag}-edges")
        if edges.isEmpty():
            return total
