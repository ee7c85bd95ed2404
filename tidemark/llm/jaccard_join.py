"""N-gram Jaccard self-join with Bayesian candidate pruning.

A document is the set of its runs of WIDTH words (fewer words: the one run of them all). Documents with equal sets
are one set with a number of copies, so copies are never paired. Two sets are linked when their Jaccard similarity
is at least the threshold.

1. Sketch: VALUES min-hashes a set. Sets that agree in a band of ROWS values are candidates (at similarity 0.8 a
   pair agrees in no band with chance 7e-5; above, with less).
2. Pruning: candidates' min-hashes are compared STAGE at a time. With m of t values equal and a uniform prior, the
   chance that the similarity reaches the threshold is P(Binomial(t + 1, threshold) <= m); below TOLERANCE the pair
   is dropped. Survivors only say which sets belong together; a task gives one edge a set, not its pairs.
3. Verification: up to GROUP sets that survivors connect meet in one place and are compared there by min-hash as before,
   and what is left exactly by their whole sets. Of larger groups the surviving pairs themselves are verified: their sets
   meet again in the blocks of the buckets in which they survived. Tasks give numbers of links and one edge a set.

Buckets of any size are cut in blocks of BLOCK, each pair of blocks a task, so none is collected in one task, and work
grows with the surviving pairs. Result: one row a
document with class_id (smallest doc_id of its connected documents) and n_links (other documents at or above the
threshold; copies count). Documents without words and rows with a null doc_id have no links; their class is their own id.
Repeated rows are copies of each other. Only the two named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, group_stream, lean, local_components, materialize, mix, pairs_in_groups, pieces, scratch, shingle_hashes, strings, word_hashes

WIDTH, THRESHOLD = 5, 0.8
VALUES, ROWS = 120, 5
STAGE, TOLERANCE = 20, 1e-8
#: Sets of one block of a bucket, and sets of a group that is compared in one place.
BLOCK, GROUP = 256, 2048
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64), 77).reshape(2, VALUES, 1)


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After t compared values, the fewest equal ones with which a pair stays."""
    out = {}
    for t in range(STAGE, VALUES + 1, STAGE):
        chance, m = 0.0, -1
        while chance < tolerance:
            m += 1
            chance += math.comb(t + 1, m) * threshold**m * (1 - threshold) ** (t + 1 - m)
        out[t] = m
    return out


def sets_of(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    words, offsets, _ = word_hashes(texts)
    grams, bounds = shingle_hashes(words, offsets, width)
    out = []
    for k in range(len(texts)):
        n = offsets[k + 1] - offsets[k]
        if 0 < n < width:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[offsets[k] : offsets[k + 1]].tobytes())], np.uint64))
        else:
            out.append(np.unique(grams[bounds[k] : bounds[k + 1]]))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of VALUES min-hashes."""
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        hashed = (_SEEDS[0] | np.uint64(1)) * shingles[at : at + 4096] + _SEEDS[1]
        low = np.minimum(low, (hashed >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return low.astype(np.uint16)


def set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketch(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi in pieces(texts):
                found = sets_of(texts[lo:hi], width)
                ids = [set_id(s) if len(s) else None for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(ids, pa.binary()), pa.array([signature(s).tobytes() if len(s) else None for s in found], pa.binary())], ["doc_id", "set_id", "sig"])

    return docs.mapInArrow(lean(run), "doc_id long, set_id binary, sig binary")


def _signatures(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def buckets(sets: DataFrame) -> DataFrame:
    """bucket, band, set_id for every band of every set."""
    bands = VALUES // ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _signatures(batch.column(1)).reshape(-1, bands, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
            for k in range(ROWS):
                key = mix(key * np.uint64(0x10001) + sig[:, :, k], k + 1)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), bands))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)), batch.column(0).take(rows)], ["bucket", "band", "set_id"])

    return sets.select("set_id", "sig").mapInArrow(lean(run), "bucket long, band int, set_id binary")


def in_blocks(members: DataFrame, key: str, size: str) -> DataFrame:
    """Members of groups of any size, dealt to pairs of blocks (x <= y): every two members meet once at least."""
    parts = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("parts")).cast("int")
    dealt = members.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other")
    # in order of set_id, so that the smallest row of a component is the same set in all tasks of a group
    return dealt.repartition(key, "x", "y").sortWithinPartitions(key, "x", "y", "set_id")


def meeting(bounds: np.ndarray, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that are compared in this task: those of one block where x = y, else those of different blocks."""
    x, y, own = (table.column(c).to_numpy() for c in ("x", "y", "own"))
    for i, j in pairs_in_groups(bounds):
        use = (own[i] != own[j]) | (x[i] == y[i])
        yield i[use], j[use]


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Places of the pairs that stay."""
    alive, equal = np.arange(len(i)), np.zeros(len(i), np.int64)
    for t, m in least.items():
        equal = equal + (sig[i[alive], t - STAGE : t] == sig[j[alive], t - STAGE : t]).sum(axis=1)
        stay = equal >= m
        alive, equal = alive[stay], equal[stay]
    return alive


def surviving_portions(table: pa.Table, bounds: np.ndarray, least: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the pairs of a task's groups that pruning leaves; in buckets, each pair in its first common band only."""
    bands = VALUES // ROWS
    sig, band = _signatures(table.column("sig")), table.column("band").to_numpy()
    for i, j in meeting(bounds, table):
        for at in range(0, len(i), 50_000):
            a, b = i[at : at + 50_000], j[at : at + 50_000]
            if band[0] >= 0:
                first = (sig[a] == sig[b]).reshape(-1, bands, ROWS).all(axis=2).argmax(axis=1)
                a, b = a[first == band[a]], b[first == band[a]]
            stay = prune(sig, a, b, least)
            yield a[stay], b[stay]


def surviving(table: pa.Table, bounds: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of surviving_portions in one."""
    none = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    left, right = zip(*none, *surviving_portions(table, bounds, least), strict=True)
    return np.concatenate(left), np.concatenate(right)


def bucket_members(sets: DataFrame) -> DataFrame:
    """Sets in the buckets that they share with others, dealt to blocks."""
    rows = buckets(sets)
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = rows.join(shared, "bucket").join(sets.select("set_id", "sig"), "set_id")
    return in_blocks(members, "bucket", "n").select("bucket", "x", "y", "own", "band", "set_id", "sig")


def candidate_edges(sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that connect all sets with a surviving pair."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_stream(batches, 3):
            label = local_components(table.num_rows, *surviving(table, bounds, least))
            child = np.flatnonzero(label != np.arange(len(label)))
            ids = table.column("set_id")
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(child)).combine_chunks(), ids.take(pa.array(label[child])).combine_chunks()], ["a", "b"])

    return bucket_members(sets).mapInArrow(lean(run), "a binary, b binary")


def surviving_members(sets: DataFrame, threshold: float) -> DataFrame:
    """Blocks of buckets without the sets that have no surviving pair there."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_stream(batches, 3):
            rows = pa.array(np.unique(np.concatenate(surviving(table, bounds, least))))
            yield pa.RecordBatch.from_arrays([table.column(c).take(rows).combine_chunks() for c in ("bucket", "x", "y", "own", "band", "set_id")], ["home", "x", "y", "own", "band", "set_id"])

    return bucket_members(sets).mapInArrow(lean(run), "home long, x int, y int, own int, band int, set_id binary")


class Overlaps:
    """Sizes of the intersections of pairs of a group's sets: one by one for few pairs, from a table of all for many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.total = sets, None

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if len(i) <= 4 * len(self.sets):
            return np.array([len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
        if self.total is None:
            self.total = self._table()
        return self.total[i, j].astype(np.int64)

    def _table(self) -> np.ndarray:
        row = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        values, code, n = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        number = np.cumsum(n > 1) - 1  # a shingle of one set alone is in no intersection
        row, code = row[(n > 1)[code]], number[code[(n > 1)[code]]]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        total = np.zeros((len(self.sets), len(self.sets)), np.float32)
        for lo in range(0, int(code.max(initial=-1)) + 1, 1024):
            a, b = np.searchsorted(code, [lo, lo + 1024])
            part = np.zeros((len(self.sets), 1024), np.float32)
            part[row[a:b], code[a:b] - lo] = 1
            total += part @ part.T
        return total


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """For each group (home, x, y) and set: links to other sets (copies counted), and the smallest set it is connected to
    there."""
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, bounds in group_stream(batches, 3, 512):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                table = whole.slice(lo, hi - lo)
                copies = table.column("copies").to_numpy()
                sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
                sizes = np.array([len(s) for s in sets])
                shared, links, pairs = Overlaps(sets), np.zeros(hi - lo, np.int64), [(np.empty(0, np.int32),) * 2]
                for i, j in surviving_portions(table, np.array([0, hi - lo]), least):
                    both = shared.of(i, j)
                    linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
                    i, j = i[linked], j[linked]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    pairs.append((i.astype(np.int32), j.astype(np.int32)))
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                ids = table.column("set_id")
                columns = [ids, ids.take(pa.array(local_components(hi - lo, i, j)))]
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in columns), pa.array(links)], ["set_id", "label", "links"])

    return members.repartition("home", "x", "y").sortWithinPartitions("home", "x", "y", "set_id").mapInArrow(lean(run), "set_id binary, label binary, links long")


def shingles_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set_id, shingles of the wanted sets (set_id, rep), from the texts of their representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = strings(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in pieces(texts):
                # one id may have several texts: the wanted one has the set's own id
                rows = [(i, s.tobytes()) for i, s in zip(ids[lo:hi], sets_of(texts[lo:hi], width), strict=True) if len(s) and set_id(s) == i]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["set_id", "shingles"])

    joined = docs.join(wanted.select(F.col("rep").alias("doc_id"), "set_id"), "doc_id").select("text", "set_id")
    return joined.mapInArrow(lean(run), "set_id binary, shingles binary")


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links for every row of docs."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        rows = materialize(sketch(base, width), "sketches")
        known = rows.filter("doc_id is not null and set_id is not null")
        sets = materialize(known.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "sets")
        homes = components(candidate_edges(sets, threshold), "candidates")
        sized = homes.join(homes.groupBy("home").agg(F.count("*").alias("n")), "home").withColumnRenamed("id", "set_id").join(sets, "set_id")
        members = materialize(sized.select("set_id", F.xxhash64("home").alias("home"), "n", "rep", "copies", "sig"), "members")
        # a repeated row of a representative gives its shingles again: one is kept
        shingles = shingles_of(base, members, width).dropDuplicates(["set_id"])
        light = members.select("set_id", "copies", "sig")
        columns = ("home", "x", "y", "own", "band", "set_id", "sig", "copies", "shingles")
        none = F.lit(0).alias
        small = members.filter(F.col("n") <= GROUP).select("home", none("x"), none("y"), none("own"), F.lit(-1).alias("band"), "set_id", "sig", "copies")
        checked = materialize(verified(small.join(shingles, "set_id").select(*columns), threshold), "verified")
        links = checked.groupBy("set_id").agg(F.sum("links").alias("links"), F.min("label").alias("home"))
        large = members.filter(F.col("n") > GROUP)
        if not large.isEmpty():
            survivors = surviving_members(large.select("set_id", "sig"), threshold)
            wide = materialize(verified(survivors.join(light, "set_id").join(shingles, "set_id").select(*columns), threshold), "verified")
            joined = components(wide.filter("set_id != label").select(F.col("set_id").alias("a"), F.col("label").alias("b")), "across")
            joined = joined.select(F.col("id").alias("set_id"), F.col("home").alias("wide"))
            counted = wide.groupBy("set_id").agg(F.sum("links").alias("links")).join(joined, "set_id", "left")
            links = links.unionByName(counted.select("set_id", "links", F.coalesce("wide", "set_id").alias("home")))
        named = sets.join(links, "set_id", "left").select("set_id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("home", "set_id").alias("home"))
        classes = named.groupBy("home").agg(F.min("rep").alias("class_id"))
        result = named.join(classes, "home").select("set_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
        found = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(result, "set_id", "left")
        return keep(found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
