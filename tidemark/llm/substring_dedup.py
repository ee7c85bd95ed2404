"""Substring dedup by compact windows.

A text is its stream of WIDTH-word shingles. For a hash function, the nodes of the Cartesian tree over the
shingles' hashes that span at least `least` shingles are its compact windows: all subsequences inside [l, r]
around c have their minimum at c. So a passage that two texts share has windows with the same minimum that
contain it, under every function for an exact repeat and under most for a near one.

1. Windows of FUNCTIONS functions give rows (slot, doc_id, at): the slot is the minimal shingle under its function, `at`
   packs c, its distances to l and r, and the function. In one sort of the slots each row meets two earlier documents:
   the slot's first and, where no passage with that one covers the row, the one just before it. Slots that hold a large share of all rows (found in a sample of
   documents) are dealt to SPREAD slots, whose first rows meet the first of them all. So no slot gives pairs.
2. Interval join: the windows that two documents share at about one distance become intervals [c - left, c + right], as
   far as both windows reach. Where intervals of ENOUGH functions meet, a passage may lie: a region.
3. Regions fetch their words from both texts, which are cut into segments of SEGMENT_WORDS, so that neither a long text
   nor one that many documents share travels whole. The longest stretch around a shared minimum whose shingle Jaccard
   similarity reaches the threshold is a passage, or else the exact run.
4. A window of the first function that no passage covers may still be an exact repeat of a document that its row did not
   meet. Rows whose half windows before or after c are equal are grouped, and where one is not covered, the hashes of all
   runs of `least` shingles around them are compared. So exact repeats are found whatever leads their slots.
5. A window that no passage covers after both meetings meets every earlier row of its slot with the same run of shingles
   beside the minimum; in words that repeat again and again this is the run in which the repetition ends or begins.
   Different texts that stay open in one run cost their pairs, dealt to cells: in arrays, the shingles around both places
   decide in which a passage lies. The likeliest source of each place is compared first, others while it stays open.

Near repeats are found by hashes (tests measure how many are). Beside a found
passage, under `words` words that only another document shares may stay.

Result: one row for each maximal repeated passage of a document: doc_id, first_word and n_words (in words that have a
letter or digit), char_start and char_end of the text, source (an earlier document with the passage; the smallest met),
is_first (the passage is the earlier occurrence itself; source is then the document) and text_hash. Repeats inside one
document and rows with a null doc_id are left out; rows that repeat a doc_id count as that document once, and where their
texts differ, text_hash (xxhash64) says which one the places are of. Null, empty and short texts have no passages. Extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, group_stream, lean, materialize, mix, pieces, powers_to, scratch, shingle_hashes, spread, strings, word_hashes, word_table

WIDTH, WORDS, SIMILARITY = 5, 50, 0.8
#: Hash functions, and how many must agree on a region.
FUNCTIONS, ENOUGH = 6, 2
#: Distances of shared minima that belong to one region differ by no more from each other (words put in or left out).
SLIP = 12
#: A slot with this share of the rows of about SAMPLE documents is dealt to SPREAD slots.
SAMPLE, HOT_SHARE, SPREAD = 4_000, 1 / 2000, 64
SEGMENT_WORDS = 4096
#: Places after which a shingle that returns is a repetition of a few words again and again.
PERIOD = 4
#: Rows of a run that late rows meet in one place.
BLOCK = 1024
#: First rank and number of the sources that are compared at once; the last of these are all others.
RANKS = ((1, 1), (2, 2), (4, 1 << 30))
#: Pairs of rows that are judged in one portion.
PAIRS = 1 << 18
#: Shingles on each side of a row's place by which two rows of a run are judged.
AROUND = 60
#: Requests for one segment are handled in so many parts at most.
PARTS = 1024
SPAN = ("first_word", "end_word", "char_start", "char_end")
#: Bits of a window's distances to its ends (longer ones count as the longest) and of its function.
_REACH, _FUNCTION = 14, 3
WINDOWS = "slot long, doc_id long, at long, beside long, hot long"


def compact_windows(values: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all Cartesian tree nodes over each row of values that span at least `least` places."""
    rows = len(offsets) - 1
    padded = np.zeros(len(values) + rows + 1, np.uint32)  # a zero before, between and after the rows
    at = np.arange(len(values)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    padded[at] = np.maximum(values, 1)
    table = [padded]
    longest = int(np.diff(offsets).max(initial=0))
    while 1 << len(table) <= longest:
        low, step = table[-1], 1 << (len(table) - 1)
        table.append(np.minimum(low[:-step], low[step:]))
    # a node of that span reaches half of it to the left or to the right
    half = least // 2
    k = half.bit_length() - 1
    if k >= len(table):
        return (np.empty(0, np.int64),) * 3
    near = np.minimum(table[k][: len(padded) - half + 1], table[k][half - (1 << k) :][: len(padded) - half + 1])  # over [i, i + half)
    left = np.zeros(len(padded), bool)
    left[half:] = near[: len(padded) - half] > padded[half:]
    right = np.zeros(len(padded), bool)
    right[: len(padded) - half] = near[1:] >= padded[: len(padded) - half]
    c = np.flatnonzero((left | right) & (padded > 0))
    own, lo, hi = padded[c], c.copy(), c.copy()
    for j in reversed(range(len(table))):
        low, step = table[j], 1 << j
        back = lo - step
        lo = np.where((back >= 0) & (low[np.maximum(back, 0)] > own), back, lo)
        on = hi + 1
        fits = on + step <= len(padded)
        hi = np.where(fits & (low[np.where(fits, on, 0)] >= own), hi + step, hi)
    wide = hi - lo + 1 >= least
    c, lo, hi = c[wide], lo[wide], hi[wide]
    shift = np.searchsorted(offsets + np.arange(rows + 1), c, "right")  # zeros up to c
    return lo - shift, c - shift, hi - shift


def run_sums(grams: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial, from which the hash of any run follows."""
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams * powers_to(len(grams) + 1)[0, : len(grams)], dtype=np.uint64, out=sums[1:])
    return sums


def run_hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of grams[s : s + length] for each start."""
    power = powers_to(len(sums))
    return mix((sums[starts + length] - sums[starts]) * power[1, starts], length)


def thinned(key: np.ndarray, row: np.ndarray, place: np.ndarray, apart: int) -> np.ndarray:
    """Of places of one key in one row, the first in each stretch of apart + 1 places: text that repeats a few words
    again and again has a window nearly everywhere. Rows and places must ascend."""
    order = np.argsort(key, kind="stable")
    key, row, place = key[order], row[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = place[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    part = (place - first) // (apart + 1)
    new[1:] |= part[1:] != part[:-1]
    return order[new]


def near_run(least: int) -> int:
    """Shingles of a run that a near repeat has in common with its passage: at similarity 0.8 a changed word costs ten of
    them in both texts together, so there is a change for every 45 at most, and of two runs left one has 21 of 46."""
    return least // 3 + 1


def beside(sums: np.ndarray, c: np.ndarray, start: np.ndarray, end: np.ndarray, half: int) -> np.ndarray:
    """Two 32-bit hashes: of the run of `half` shingles that begins at c, and of the one that ends there (0 without room)."""
    out = np.zeros(len(c), np.uint64)
    for shift, first in ((32, c), (0, c - half + 1)):
        room = (first >= start) & (first + half <= end)
        out[room] |= np.maximum(run_hashes(sums, first[room], half) >> np.uint64(32), np.uint64(1)) << np.uint64(shift)
    return out


def runs_beside(sums: np.ndarray, c: np.ndarray, start: np.ndarray, end: np.ndarray, half: int, turns: Turns) -> np.ndarray:
    """The same, but where c lies in words that repeat on that side, the run is of the WIDTH shingles in which the repetition turns
    into other text. A run inside a repetition says no more than c itself: all texts with enough of these words share it."""
    out = beside(sums, c, start, end, half)
    for shift, held, first in ((32, turns.on[c], turns.after[c]), (0, turns.back[c], turns.before[c] - WIDTH + 1)):
        out[held] &= np.uint64(0xFFFFFFFF << (32 - shift))
        room = held & (first >= start) & (first + WIDTH <= end)
        out[room] |= np.maximum(mix(run_hashes(sums, first[room], WIDTH), 7) >> np.uint64(32), np.uint64(1)) << np.uint64(shift)
    return out


class Turns:
    """For each shingle of some texts: whether it stands again within PERIOD places behind it (on) or before it (back), and from
    there the first place that doesn't return behind it (after) and the last that doesn't before it (before): where the repetition
    ends and begins."""

    def __init__(self, grams: np.ndarray, bounds: np.ndarray):
        n = len(grams)
        self.on, self.back = np.zeros(n, bool), np.zeros(n, bool)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for d in range(1, min(PERIOD, n - 1) + 1):
            same = (grams[d:] == grams[:-d]) & (text[d:] == text[:-d])
            self.on[:-d] |= same
            self.back[d:] |= same
        at = np.arange(n)
        self.after = np.minimum.accumulate(np.where(self.on, n, at)[::-1])[::-1] if n else at
        self.before = np.maximum.accumulate(np.where(self.back, -1, at)) if n else at


def pack(place: np.ndarray, back: np.ndarray, ahead: np.ndarray, function: int) -> np.ndarray:
    top = (1 << _REACH) - 1
    return (((place << _REACH | np.minimum(back, top)) << _REACH | np.minimum(ahead, top)) << _FUNCTION) | function


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, distance to l, distance to r, function."""
    top, reach = (1 << _REACH) - 1, at >> _FUNCTION
    return reach >> 2 * _REACH, reach >> _REACH & top, reach & top, at & (1 << _FUNCTION) - 1


def windows(docs: DataFrame, width: int, least: int, hot: np.ndarray) -> DataFrame:
    """A row for each compact window of each function; hot keys (sorted) are dealt to SPREAD slots by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = strings(batch.column(1)), batch.column(0).to_numpy()
            for lo, hi in pieces(texts):
                words, offsets, _ = word_hashes(texts[lo:hi])
                grams, bounds = shingle_hashes(words, offsets, width)
                sums, turns = run_sums(grams), Turns(grams, bounds)
                for f in range(FUNCTIONS):
                    hashed = mix(grams, 101 + f)
                    left, c, right = compact_windows((hashed >> np.uint64(32)).astype(np.uint32), bounds, least)
                    row = np.searchsorted(bounds, c, "right") - 1
                    key = hashed[c]
                    near = runs_beside(sums, c, bounds[row], bounds[row + 1], near_run(least), turns) if f else beside(sums, c, bounds[row], bounds[row + 1], least // 2)
                    kept = thinned(key ^ mix(near, 5), row, c, least // 2)
                    left, c, right, row, key, near = (x[kept] for x in (left, c, right, row, key, near))
                    doc = ids[lo:hi][row]
                    slot, is_hot = key.view(np.int64), np.zeros(len(c), bool)
                    if len(hot):
                        is_hot = hot[np.minimum(np.searchsorted(hot, slot), len(hot) - 1)] == slot
                    dealt = mix(key ^ (mix(doc.view(np.uint64), 3) % np.uint64(SPREAD)), 4).view(np.int64)
                    columns = [np.where(is_hot, dealt, slot), doc, pack(c - bounds[row], c - left, right - c, f), near.view(np.int64), np.where(is_hot, slot, 0)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["slot", "doc_id", "at", "beside", "hot"])

    return docs.mapInArrow(lean(run), WINDOWS)


def hot_keys(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """Keys with at least HOT_SHARE of the rows of a sample of documents: at most 1 / HOT_SHARE keys. They decide how
    rows are dealt to tasks, not what is found."""
    share = max(1, docs.count() // SAMPLE)
    sample = windows(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), width, least, np.empty(0, np.int64))
    counts = sample.groupBy("slot").agg(F.count("*").alias("n"))
    row = counts.agg(F.sum("n").alias("rows"), F.collect_list(F.when(F.col("n") >= 64, F.struct("slot", "n"))).alias("often")).first()
    return np.sort(np.array([r.slot for r in row.often if r.n >= HOT_SHARE * row.rows], np.int64))


def shared_windows(docs: DataFrame, width: int, least: int) -> DataFrame:
    """Windows whose slot two documents have (and all hot ones), with the slot's first row and the last row of an
    earlier document."""
    rows = windows(docs, width, least, hot_keys(docs, width, least))
    slot = Window.partitionBy("slot")
    one = F.struct("doc_id", "at")
    first = F.first(one).over(slot.orderBy("doc_id", "at").rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(one).over(slot.orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1))
    met = rows.withColumn("first", first).withColumn("before", before).withColumn("last", F.max("doc_id").over(slot))
    return met.filter("hot != 0 or last > first.doc_id").drop("last")


def meetings(shared: DataFrame) -> DataFrame:
    """doc_id, at, source, source_at for every window and the first document of its slot."""
    met = shared.filter("doc_id > first.doc_id").select("doc_id", "at", F.col("first").alias("m"))
    # the first rows of the slots of a hot key: SPREAD documents a key
    leads = shared.filter("hot != 0 and doc_id = first.doc_id").withColumn("m", F.first(F.struct("doc_id", "at")).over(Window.partitionBy("hot").orderBy("doc_id", "at")))
    return met.unionByName(leads.filter("m.doc_id < doc_id").select("doc_id", "at", "m")).select("doc_id", "at", F.col("m.doc_id").alias("source"), F.col("m.at").alias("source_at"))


def uncovered(rows: DataFrame, spans: DataFrame, width: int, around: int) -> DataFrame:
    """rows (doc_id, place) with open: whether no passage that the document repeats covers them, and copied: whether an exact repeat
    covers `around` shingles before them and twice as many behind."""
    known = spans.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word", "exact")).alias("known"))
    covers = lambda x: (x["first_word"] <= F.col("place")) & (F.col("place") + width <= x["end_word"])
    wide = lambda x: (x["exact"] == 1) & (x["first_word"] <= F.greatest(F.col("place") - around, F.lit(0))) & (F.col("place") + 2 * around + width <= x["end_word"])
    no = F.lit(False)
    return rows.join(known.hint("shuffle_hash"), "doc_id", "left").withColumns({"open": ~F.coalesce(F.exists("known", covers), no), "copied": F.coalesce(F.exists("known", wide), no)}).drop("known")


def later_meetings(shared: DataFrame, spans: DataFrame, width: int, least: int) -> DataFrame:
    """The same for windows that no passage covers yet, and the last document before theirs in their slot."""
    rows = shared.filter("before.doc_id != first.doc_id").select("doc_id", "at", F.shiftright("at", 2 * _REACH + _FUNCTION).alias("place"), F.col("before.doc_id").alias("source"), F.col("before.at").alias("source_at"))
    return uncovered(rows, spans, width, least).filter("open").select("doc_id", "at", "source", "source_at")


def crowds(shared: DataFrame, spans: DataFrame, width: int, least: int) -> DataFrame:
    """run, doc_id, at, late, twin: the windows of slots in which a row has earlier ones that it did not meet, once for each run of
    near_run shingles beside their minimum. late: no passage covers the row yet. twin: the run on the minimum's other side, where
    rows that share it have met already. Rows well inside an exact copy of earlier text
    are left out: what they are copied from is there itself, and so are the copy's rows near its ends."""
    of = F.col("at").bitwiseAND((1 << _FUNCTION) - 1)
    unmet = (F.col("hot") != 0) | F.coalesce((F.col("before.doc_id") != F.col("first.doc_id")) | (F.col("before.at") != F.col("first.at")), F.lit(False))
    rows = shared.filter(of != 0).select("doc_id", "at", F.shiftright("at", 2 * _REACH + _FUNCTION).alias("place"), F.when(F.col("hot") != 0, F.col("hot")).otherwise(F.col("slot")).alias("key"), "beside", unmet.alias("unmet"))
    open_keys = uncovered(rows.filter("unmet").select("doc_id", "place", "key"), spans, width, least).filter("open").select("key").distinct()
    own = uncovered(rows.join(open_keys.hint("shuffle_hash"), "key", "left_semi"), spans, width, near_run(least) // 2).filter("not copied")
    halves = F.array(F.shiftrightunsigned("beside", 32), F.col("beside").bitwiseAND(0xFFFFFFFF))
    return own.select("doc_id", "at", (F.col("open") & F.col("unmet")).alias("late"), "key", halves.alias("halves"), F.posexplode(halves).alias("side", "half")).filter("half != 0").select(F.xxhash64("key", "side", "half").alias("run"), "doc_id", "at", "late", F.expr("if(side = 1 and halves[0] != 0, halves[0], null)").alias("twin"))


def cells(crowd: DataFrame) -> DataFrame:
    """The rows of runs in which a late row has earlier ones, dealt to cells (run, a, b) of about BLOCK rows on each side: each late
    row meets each earlier document's row of its run in one cell. from_late, from_source: the sides on which a row stands there."""
    runs = crowd.groupBy("run").agg(F.min("doc_id").alias("first"), F.max(F.when(F.col("late"), F.col("doc_id"))).alias("last"), F.count("*").alias("n")).filter("first < last")
    near = crowd.join(runs.select("run", "last", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).hint("shuffle_hash"), "run").filter("late or doc_id < last").drop("last")
    every, own = F.sequence(F.lit(0), F.col("blocks") - 1), F.pmod(F.xxhash64("doc_id", "at"), F.col("blocks")).cast("int")
    cell = lambda a, b, late, source: F.struct(a.alias("a"), b.alias("b"), late.alias("from_late"), source.alias("from_source"))
    asks = F.when(F.col("late"), F.transform(every, lambda j: cell(own, j, F.lit(True), own == j)))
    answers = F.transform(F.filter(every, lambda i: ~F.col("late") | (i != own)), lambda i: cell(i, own, F.lit(False), F.lit(True)))
    return near.withColumn("cell", F.explode(F.concat(F.coalesce(asks, F.slice(answers, 1, 0)), answers))).select("run", "cell.*", *(c for c in near.columns if c not in ("run", "late", "blocks")))


def near_stretches(own: np.ndarray, other: np.ndarray, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of the shingles around two places: whether a passage of `least` shingles lies around them, as match() would find
    it, where it starts and ends, and by how much it is near enough. Zeros stand for no shingle; the middle shingles are equal."""
    n, wide = own.shape
    span = wide - 2 * SLIP
    mid = span // 2
    ok, starts, ends, margin = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    middle = own[:, SLIP : SLIP + span]
    covered = np.zeros((n, span), bool)
    for d in range(2 * SLIP + 1):
        covered |= middle == other[:, d : d + span]
    covered &= middle != 0
    covered[:, mid] = True
    # of fewer covered places no stretch is long and covered enough
    left = np.flatnonzero(np.count_nonzero(covered, axis=1) >= int(least * similarity))
    column = np.arange(span)
    for x in (similarity / (1 - similarity), 2 * similarity / (1 - similarity)) if similarity < 1 else (span,):
        on = covered[left]
        gain = np.zeros((len(left), span + 1), np.float32)
        np.cumsum(np.where(on, np.float32(1), np.float32(-x)), axis=1, out=gain[:, 1:])
        s = np.argmax(gain[:, : mid + 1] <= gain[:, mid + 1 :].max(axis=1, initial=-np.inf)[:, None], axis=1)
        base = np.take_along_axis(gain, s[:, None], 1)
        e = span - np.argmax((gain >= base)[:, ::-1], axis=1)
        inside = on & (column >= s[:, None]) & (column < e[:, None])
        s, e = np.argmax(inside, axis=1), span - np.argmax(inside[:, ::-1], axis=1)
        long = np.flatnonzero(e - s >= least)
        k, s, e = left[long], s[long], e[long]
        places = np.arange(wide)
        of = [np.argmin(np.where(other[k] == middle[k, at][:, None], np.abs(places - (SLIP + at)[:, None]), wide), axis=1) for at in (s, e - 1)]
        here = np.where((column >= s[:, None]) & (column < e[:, None]), middle[k], np.uint16(0))
        there = np.where((places >= of[0][:, None]) & (places <= of[1][:, None]), other[k], np.uint16(0))
        whole = _distinct(np.concatenate([here, there], axis=1))
        common = _distinct(here) + _distinct(there) - whole
        near = common >= (similarity - 0.01) * whole  # two of these hashes may be equal
        ok[k[near]], starts[k[near]], ends[k[near]], margin[k[near]] = True, s[near] - mid, e[near] - mid, (common - similarity * whole)[near]
        left = left[~ok[left]]
    return ok, starts, ends, margin


def _distinct(codes: np.ndarray) -> np.ndarray:
    """How many different values other than zero each row has."""
    codes = np.sort(codes, axis=1)
    return np.count_nonzero((codes[:, 1:] != codes[:, :-1]) & (codes[:, 1:] != 0), axis=1) + (codes[:, 0] != 0)


MET = "doc_id long, at long, found_at array<long>, source array<long>, source_at array<long>"


def near_sources(dealt: DataFrame, least: int, similarity: float) -> DataFrame:
    """MET: for each late row of a cell the earlier documents' rows that it meets; with rows' surroundings (`around`) only those in
    which a passage lies around both places, the likeliest first. The places then reach over that passage."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["run", "a", "b", "doc_id", "at", "twin", "from_late", "from_source", *(["around"] if "around" in dealt.columns else [])]
    ordered = dealt.select(columns).repartition(parts, "run", "a", "b").sortWithinPartitions("run", "a", "b", "doc_id", "at")
    names = [c.split()[0] for c in MET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_stream(batches, 3):
            doc, at = (table.column(c).to_numpy() for c in ("doc_id", "at"))
            twin = table.column("twin")
            has, twin = twin.is_valid().to_numpy(), pc.fill_null(twin, 0).to_numpy()
            asks, answers = (table.column(c).to_numpy() for c in ("from_late", "from_source"))
            around = np.frombuffer(b"".join(table.column("around").to_pylist()), np.uint16).reshape(len(doc), -1) if "around" in table.column_names else None
            late = np.flatnonzero(asks)
            group = np.searchsorted(bounds, late, "right") - 1
            # rows of a cell ascend by document: a row meets those before its own
            total = np.cumsum(late - bounds[group])
            cuts = [0, *(np.flatnonzero(np.diff(total // PAIRS)) + 1).tolist(), len(late)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                own = np.repeat(late[lo:hi], (late - bounds[group])[lo:hi])
                other = spread(bounds[group][lo:hi], (late - bounds[group])[lo:hi])
                use = answers[other] & (doc[other] < doc[own]) & ~(has[own] & has[other] & (twin[own] == twin[other]))
                own, other = own[use], other[use]
                place, back, ahead, function = unpack(at[own])
                of, of_back, of_ahead, of_function = unpack(at[other])
                margin = np.zeros(len(own))
                if around is not None:
                    found = [near_stretches(around[own[k : k + 4096]], around[other[k : k + 4096]], least, similarity) for k in range(0, len(own), 4096)]
                    ok, start, end, margin = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, t) for t in (bool, np.int64, np.int64, float))
                    own, other, place, of, function, of_function, start, end, margin = (x[ok] for x in (own, other, place, of, function, of_function, start, end, margin))
                    back = of_back = -start
                    ahead = of_ahead = end - 1
                order = np.lexsort((doc[other], -margin, own))
                mine = own[order]
                heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.empty(0, np.int64)
                offsets = pa.array(np.append(heads, len(mine)), pa.int32())
                lists = [pack(place, back, ahead, function)[order], doc[other][order], pack(of, of_back, of_ahead, of_function)[order]]
                yield pa.RecordBatch.from_arrays([pa.array(doc[mine[heads]]), pa.array(at[mine[heads]]), *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in lists)], names)

    return ordered.mapInArrow(lean(run), MET)


def each_source(met: DataFrame, first: int = 1, most: int = 1 << 30) -> DataFrame:
    """doc_id, at, source, source_at of MET: `most` sources from that rank on."""
    some = F.slice(F.arrays_zip("found_at", "source", "source_at"), first, most)
    return met.select("doc_id", F.explode(some).alias("m")).select("doc_id", F.col("m.found_at").alias("at"), "m.source", "m.source_at")


def all_meetings(crowd: DataFrame) -> DataFrame:
    """doc_id, at, source, source_at for each late row and every earlier document's row with its run."""
    return each_source(near_sources(cells(crowd), 0, 0))


def with_surroundings(docs: DataFrame, dealt: DataFrame, width: int) -> DataFrame:
    """dealt with the shingles around each row's place, AROUND on each side and SLIP more, as 16-bit hashes in bytes (`around`)."""
    rows = [c for c in dealt.columns if c != "doc_id"]
    lists = dealt.groupBy("doc_id").agg(F.collect_list(F.struct(*rows)).alias("rows"))
    joined = asked_for(docs, dealt.select("doc_id")).join(lists, "doc_id").select("doc_id", "text", "rows")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    reach = AROUND + SLIP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            for lo, hi in pieces(texts):
                words, offsets, _ = word_hashes(texts[lo:hi])
                grams, bounds = shingle_hashes(words, offsets, width)
                codes = np.maximum(mix(grams, 77) >> np.uint64(48), np.uint64(1)).astype(np.uint16)
                lists = batch.column(2)[lo:hi]
                n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                text, flat = np.repeat(np.arange(hi - lo), n), lists.flatten()
                for k in range(0, len(text), 8192):  # a long text may have very many rows
                    some, own = flat.slice(k, 8192), text[k : k + 8192]
                    place = bounds[own] + (some.field("at").to_numpy() >> 2 * _REACH + _FUNCTION)
                    at = place[:, None] + np.arange(-reach, reach + 1)
                    inside = (at >= bounds[own][:, None]) & (at < bounds[own + 1][:, None])
                    around = np.where(inside, codes[np.where(inside, at, 0)], np.uint16(0)) if len(codes) else np.zeros(at.shape, np.uint16)
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * at.shape[1]), len(around), [None, pa.py_buffer(np.ascontiguousarray(around).tobytes())]).cast(pa.binary())
                    columns = {"doc_id": batch.column(0)[lo:hi].take(pa.array(own)), "around": raw} | {c: some.field(c) for c in rows}
                    names = [*dealt_columns, "around"]
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    dealt_columns = dealt.columns
    return joined.mapInArrow(lean(run), f"{schema}, around binary")


def scan(pair: np.ndarray, at: np.ndarray, source_at: np.ndarray, least: int, enough: int = ENOUGH) -> tuple[np.ndarray, ...]:
    """Interval join of the windows that pairs share: pair, start, end, and least and largest distance of each region in
    which intervals of `enough` functions meet over `least` places or more. pair must ascend."""
    c, back, ahead, function = unpack(at)
    of, of_back, of_ahead, _ = unpack(source_at)
    apart = of - c
    order = np.lexsort((apart, pair))
    new = np.ones(len(order), bool)
    new[1:] = (pair[order][1:] != pair[order][:-1]) | (np.diff(apart[order]) > SLIP)
    cluster = np.empty(len(order), np.int64)
    cluster[order] = np.cumsum(new) - 1
    firsts = np.flatnonzero(new)
    low, high = np.minimum.reduceat(apart[order], firsts), np.maximum.reduceat(apart[order], firsts)
    of_pair = pair[order][firsts]
    start, end = c - np.minimum(back, of_back), c + np.minimum(ahead, of_ahead) + 1
    # the intervals of one function overlap each other: they count once
    group = cluster << _FUNCTION | function
    order = np.lexsort((start, group))
    group, start, end = group[order], start[order], end[order]
    reach = np.maximum.accumulate((group << 33) + end) - (group << 33)
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1])
    firsts = np.flatnonzero(new)
    group, start, end = group[firsts] >> _FUNCTION, start[firsts], np.maximum.reduceat(end, firsts)
    # sweep: where `enough` intervals lie over each other
    event = np.concatenate([start, end])
    of_cluster, turn = np.concatenate([group, group]), np.repeat([1, -1], len(start))
    order = np.lexsort((-turn, event, of_cluster))
    event, of_cluster, depth = event[order], of_cluster[order], np.cumsum(turn[order])
    inside = depth >= enough
    rise = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    fall = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
    long = event[fall] - event[rise] >= least
    k = of_cluster[rise][long]
    return of_pair[k], event[rise][long], event[fall][long], low[k], high[k]


def regions(met: DataFrame, width: int, least: int, enough: int = ENOUGH) -> DataFrame:
    """region (a number), doc_id, source, first words and end words in both, and the shared minima as words of the region."""
    functions = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("at").bitwiseAND((1 << _FUNCTION) - 1).cast("int"))))
    pairs = met.groupBy("doc_id", "source").agg(functions.alias("n"), F.collect_list("at").alias("at"), F.collect_list("source_at").alias("source_at")).filter(F.col("n") >= enough)
    names = ["region", "doc_id", "source", "start", "end", "source_start", "source_end", "inner", "place", "of"]
    near = int(least * SIMILARITY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            pair = np.repeat(np.arange(batch.num_rows), n)
            at, source_at = (batch.column(k).flatten().to_numpy() for k in (2, 3))
            if not len(at):
                continue
            of_pair, start, end, low, high = scan(pair, at, source_at, near, enough)
            c, of = unpack(at)[0], unpack(source_at)[0]
            bounds = np.searchsorted(pair, np.arange(batch.num_rows + 1))
            places, others = [], []
            begin, stop = np.maximum(start - SLIP, 0), end + SLIP + width - 1
            source_begin, source_stop = np.maximum(start + low - SLIP, 0), end + high + SLIP + width - 1
            for k in range(len(of_pair)):
                lo, hi = bounds[of_pair[k]], bounds[of_pair[k] + 1]
                own, other = c[lo:hi], of[lo:hi]
                use = (own >= start[k]) & (own < end[k]) & (other - own >= low[k]) & (other - own <= high[k])
                seeds = np.unique(own[use] << 32 | other[use])
                places.append((seeds >> 32) - begin[k])
                others.append((seeds & 0xFFFFFFFF) - source_begin[k])
            rows = pa.array(of_pair)
            columns = [pa.array(number + np.arange(len(of_pair))), batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x) for x in (begin, stop, source_begin, source_stop, end - start))]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (places, others)]
            number += len(of_pair)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} long" for n in names[:-2]) + ", place array<long>, of array<long>"
    return pairs.select("doc_id", "source", "at", "source_at").mapInArrow(lean(run), schema)


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, segment, char_start, text: every text in runs of SEGMENT_WORDS words."""
    names = ["doc_id", "text_hash", "segment", "char_start", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            long = pc.greater(pc.utf8_length(texts), 2 * SEGMENT_WORDS - 2).to_numpy(zero_copy_only=False)
            short = pa.array(~long)
            n = int((~long).sum())
            zeros = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(short), batch.column(1).filter(short), zeros, zeros, texts.filter(short).cast(pa.string())], names)
            for k in np.flatnonzero(long).tolist():
                text = texts[k].as_py()
                starts = word_table(texts[k : k + 1]).starts[::SEGMENT_WORDS].tolist() or [0]
                starts[0] = 0
                cuts = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
                same = pa.array([k] * len(cuts))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), pa.array(range(len(cuts)), pa.int64()), pa.array(starts, pa.int64()), pa.array(cuts, pa.string())], names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(lean(run), "doc_id long, text_hash long, segment long, char_start long, text string")


#: Buckets of document ids by which texts that no region needs are left out before they are cut.
BUCKETS = 1 << 16
PIECES = "id long, role int, text_hash long, segment long, first_word long, char_start long, text string"


def asked_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most of those of which nothing is wanted; what is sent to all tasks has BUCKETS rows at most."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    return docs.select("*", bucket).join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """PIECES of the wanted words (id, role, doc_id, start, end), a row for each segment that they lie in.

    What a document needs of itself is one request list for a segment. A source that many documents ask for is asked in
    PARTS parts; so a list is never that of all."""
    asked = wanted.withColumn("segment", F.explode(F.sequence(F.expr(f"start div {SEGMENT_WORDS}"), F.expr(f"(end - 1) div {SEGMENT_WORDS}"))))
    lists = asked.groupBy("doc_id", "segment", F.when(F.col("role") == 0, -1).otherwise(F.pmod(F.xxhash64("id"), F.lit(PARTS))).alias("part")).agg(F.collect_list(F.struct("id", "role", "start", "end")).alias("asked"))
    joined = lists.join(segments(docs), ["doc_id", "segment"]).select("asked", "segment", "text_hash", "char_start", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            texts = strings(batch.column(4))
            for lo, hi in pieces(texts):
                words = word_table(texts[lo:hi])
                rows: list[tuple] = []
                for k in range(hi - lo):
                    own = slice(words.offsets[k], words.offsets[k + 1])
                    n = int(own.stop - own.start)
                    text, segment, text_hash, base = texts[lo + k].as_py(), *(batch.column(i)[lo + k].as_py() for i in (1, 2, 3))
                    first = segment * SEGMENT_WORDS
                    for one in batch.column(0)[lo + k].as_py():
                        a, b = max(one["start"] - first, 0), min(one["end"] - first, n)
                        if a >= b:
                            continue
                        start = int(words.starts[own][a]) if a else 0
                        end = int(words.ends[own][b - 1]) if b < n else len(text)
                        rows.append((one["id"], one["role"], text_hash, segment, first + a, base + start, text[start:end]))
                columns = zip(*rows, strict=True) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _PIECE_TYPES, strict=True)], names)

    return joined.mapInArrow(lean(run), PIECES)


_PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())


def stretches(gain: np.ndarray, covered: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the places, which are covered, the longest [s, e) around it with no loss of gain (prefix sums), which starts
    and ends covered."""
    low, high = np.minimum.accumulate(gain[:-1]), np.maximum.accumulate(gain[::-1])[::-1]
    s = np.searchsorted(-low, -high[places + 1])
    e = np.searchsorted(-high, -gain[s], "right") - 1
    marked = np.flatnonzero(covered)
    return marked[np.searchsorted(marked, s)], marked[np.searchsorted(marked, e) - 1] + 1


def exact_run(a: np.ndarray, b: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """Start and end in a of the run around place p that is the same in b around q."""
    starts, ends = exact_runs_around(a, b, np.array([p]), np.array([q]))
    return int(starts[0]), int(ends[0])


def exact_runs_around(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many places: those at one distance share a comparison."""
    starts, ends = np.empty(len(p), np.int64), np.empty(len(p), np.int64)
    apart = q - p
    for d in set(apart.tolist()):
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        stop = np.concatenate([[lo - 1], lo + np.flatnonzero(a[lo:hi] != b[lo + d : hi + d]), [hi]])
        of = np.flatnonzero(apart == d)
        at = np.searchsorted(stop, p[of])
        starts[of], ends[of] = stop[at - 1] + 1, stop[at]
    return starts, ends


def match(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, inner: int, least: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages (start and end in a, start and end in b, whether it is an exact run) around shared places p of a, q of b.
    Where the exact run is as long as the region (inner), it is the passage.

    Else, at similarity J, a share J of a stretch is covered by the other's shingles. The longest stretch that is covered so
    far is tried, then one that is covered more densely, then the exact run.
    """
    inside = (p < len(a)) & (q < len(b))
    p, q = p[inside], q[inside]
    same = a[p] == b[q]
    p, q = p[same], q[same]
    if not len(p):
        return []
    s, e = exact_run(a, b, int(p[0]), int(q[0]))
    if e - s >= max(inner, least):
        apart = int(q[0] - p[0])
        return [(s, e, s + apart, e + apart, 1)]
    found: list[tuple[int, int, int, int, int]] = []
    tried: list[tuple[int, int]] = []
    values, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    own, other = code[: len(a)], code[len(a) :]
    covered = _marks(other, len(values))[own]
    penalties = [similarity / (1 - similarity), 2 * similarity / (1 - similarity)] if similarity < 1 else []
    gains = [np.concatenate([[0], np.cumsum(np.where(covered, 1.0, -x - 1e-9))]) for x in penalties]
    if gains:  # around most places of texts that are not near there is nothing long enough; exact runs are covered, too
        s, e = stretches(gains[0], covered, p)
        p, q = p[e - s >= least], q[e - s >= least]
    around = [stretches(gain, covered, p) for gain in gains]
    starts, run_ends = exact_runs_around(a, b, p, q)
    for k, (i, j) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        if any(s <= i < e for s, e, *_ in found):
            continue
        got = None
        for firsts, lasts in around if not any(s <= i < e for s, e in tried) else []:
            s, e = int(firsts[k]), int(lasts[k])
            if e - s < least:
                continue
            # the other's ends: where it has the first and the last shingle, nearest to their distance from j
            ends = []
            for at in (s, e - 1):
                places = np.flatnonzero(other == own[at])
                ends.append(int(places[np.argmin(np.abs(places - (j + at - i)))]))
            if ends[1] >= ends[0]:
                here, there = _marks(own[s:e], len(values)), _marks(other[ends[0] : ends[1] + 1], len(values))
                if np.count_nonzero(here & there) >= similarity * np.count_nonzero(here | there):
                    got = (s, e, ends[0], ends[1] + 1, 0)
                    break
            tried.append((s, e))
        if got is None:
            s, e = int(starts[k]), int(run_ends[k])
            if e - s >= least:
                got = (s, e, s + j - i, e + j - i, 1)
        if got:
            found.append(got)
    return found


def _marks(codes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[codes] = True
    return out


class Side:
    """One text's piece of a region: its shingles and where its words lie in the document."""

    def __init__(self, first_word: int, char_start: int, grams: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.first_word, self.char_start, self.grams, self.starts, self.ends = first_word, char_start, grams, starts, ends

    def span(self, start: int, end: int, width: int) -> tuple[int, int, int, int]:
        last = end + width - 2
        return self.first_word + start, self.first_word + last + 1, self.char_start + int(self.starts[start]), self.char_start + int(self.ends[last])


def places_of(found: DataFrame) -> DataFrame:
    """region, doc_id, n and place: the shared minima of the regions as words of the document, and how many the region has."""
    return found.select("region", "doc_id", F.size("place").alias("n"), F.col("start").alias("begin"), F.explode("place").alias("at")).select("region", "doc_id", "n", (F.col("begin") + F.col("at")).alias("place"))


def likeliest(found: DataFrame) -> DataFrame:
    """region: for each place of a document, the one in which it has most in common with a source."""
    best = F.max_by("region", F.struct("n", -F.col("region")))
    return places_of(found).groupBy("doc_id", "place").agg(best.alias("region")).select("region").distinct()


def sides(found: DataFrame) -> DataFrame:
    """The words that the regions need: id, role (0: of the document, 1: of the source), doc_id, start, end."""
    both = F.array(F.struct(F.lit(0).alias("role"), "doc_id", "start", "end"), F.struct(F.lit(1).alias("role"), F.col("source").alias("doc_id"), F.col("source_start").alias("start"), F.col("source_end").alias("end")))
    return found.select(F.col("region").alias("id"), F.explode(both).alias("x")).select("id", "x.*")


def compare(found: DataFrame, texts: DataFrame, width: int, least: int, similarity: float) -> DataFrame:
    """Passages of the regions, whose words are in texts: doc_id, text_hash, places, and the same of the source."""
    heads = found.select(F.col("region").alias("id"), F.lit(-1).alias("role"), F.lit(0).cast("long").alias("text_hash"), F.lit(0).cast("long").alias("segment"), "doc_id", "source", "inner", "place", "of")
    both = heads.unionByName(texts, allowMissingColumns=True).repartition("id").sortWithinPartitions("id", "role", "text_hash", "segment")
    names = ["doc_id", "text_hash", *SPAN, "source", "source_hash", *(f"source_{c}" for c in SPAN), "exact"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_stream(batches, 1, 512):
            role, text_hash, segment = (table.column(c).to_numpy() for c in ("role", "text_hash", "segment"))
            column = {c: table.column(c).to_pylist() for c in ("doc_id", "source", "inner", "first_word", "char_start", "text")}
            place, of = (table.column(c).combine_chunks() for c in ("place", "of"))
            seed_bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(place), 0).to_numpy(zero_copy_only=False))])
            place, of = (x.flatten().to_numpy() for x in (place, of))
            whole: list[tuple] = []  # head row, role, text_hash, first word, char_start, text
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for side in (0, 1):
                    k = [i for i in range(lo, hi) if role[i] == side]
                    # one text of the id, each segment once
                    k = [i for j, i in enumerate(k) if text_hash[i] == text_hash[k[0]] and (not j or segment[i] != segment[k[j - 1]])]
                    if k:
                        whole.append((lo, side, int(text_hash[k[0]]), column["first_word"][k[0]], column["char_start"][k[0]], "".join(column["text"][i] for i in k)))
            joined = pa.array([w[5] for w in whole], pa.large_string())
            rows: list[tuple] = []
            sides: dict[int, tuple] = {}
            for lo, hi in pieces(joined):
                words = word_table(joined[lo:hi])
                grams, cuts = shingle_hashes(words.hashes, words.offsets, width)
                for k, (head, side, hashed, first, char, _) in enumerate(whole[lo:hi]):
                    at = slice(words.offsets[k], words.offsets[k + 1])
                    one = (hashed, Side(first, char, grams[cuts[k] : cuts[k + 1]], words.starts[at], words.ends[at]))
                    if side == 0:
                        sides = {head: one}
                    elif head in sides and role[head] == -1:
                        own_hash, own = sides.pop(head)
                        other = one[1]
                        for s, e, t, u, exact in match(own.grams, other.grams, *(x[seed_bounds[head] : seed_bounds[head + 1]] for x in (place, of)), column["inner"][head], least, similarity):
                            rows.append((column["doc_id"][head], own_hash, *own.span(s, e, width), column["source"][head], hashed, *other.span(t, u, width), exact))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names)

    return both.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def compared(docs: DataFrame, found: DataFrame, width: int, least: int, similarity: float) -> DataFrame:
    """The passages of regions that few of the documents have."""
    with scratch(docs.sparkSession) as keep:
        found = materialize(found, "regions", compression="zstd")
        wanted = sides(found)
        return keep(compare(found, fetch(asked_for(docs, wanted), wanted), width, least, similarity), "passages")


def missed(shared: DataFrame, spans: DataFrame, width: int, least: int) -> DataFrame:
    """id, role, doc_id, start, end, open: words around the first function's windows that may hold an exact repeat not found
    yet, and those that it may repeat. What is copied from an earlier document is there once, in that document."""
    place = F.shiftright("at", 2 * _REACH + _FUNCTION)
    rows = shared.filter(F.col("at").bitwiseAND((1 << _FUNCTION) - 1) == 0).select("doc_id", place.alias("place"), F.when(F.col("hot") != 0, F.col("hot")).otherwise(F.col("slot")).alias("key"), "beside")
    halves = F.array(F.shiftrightunsigned("beside", 32), F.col("beside").bitwiseAND(0xFFFFFFFF))
    keyed = uncovered(rows, spans, width, least).filter("not copied").select("doc_id", "place", "open", "key", F.posexplode(halves).alias("side", "half")).filter("half != 0").select("doc_id", "place", "open", F.xxhash64("key", "side", "half").alias("key"))
    # a group whose later documents are all covered has nothing to find
    keys = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("b")).filter("a < b").select("key")
    near = keyed.join(keys.hint("shuffle_hash"), "key", "left_semi").groupBy("doc_id", "place").agg(F.max("open").alias("open"))
    ranges = near.select("doc_id", "open", F.greatest(F.col("place") - (least - 1), F.lit(0)).alias("start"), (F.col("place") + least + least // 2 + width).alias("end"))
    return united(ranges, ["doc_id", "open"], "start", "end").select((-1 - F.monotonically_increasing_id()).alias("id"), F.lit(0).alias("role"), "doc_id", "start", "end", "open")


def united(spans: DataFrame, key: list[str], start: str, end: str, *more: Column) -> DataFrame:
    """Unions of overlapping or touching spans of each key, with more aggregates."""
    one = Window.partitionBy(*key).orderBy(start, end)
    new = F.when(F.col(start) <= F.max(end).over(one.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    islands = spans.withColumn("new", new).withColumn("island", F.sum("new").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "island").agg(F.min(start).alias(start), F.max(end).alias(end), *more).drop("island")


def exact_runs(wanted: DataFrame, texts: DataFrame, width: int, least: int) -> DataFrame:
    """Hashes and places of all runs of `least` shingles in the wanted words, which are in texts."""
    owners = wanted.select(F.col("id").alias("_id"), "doc_id", F.col("open").cast("long").alias("open"))
    sorted_pieces = texts.join(owners, F.col("id") == F.col("_id")).drop("_id").repartition("id").sortWithinPartitions("id", "text_hash", "segment")
    names = ["key", "open", "doc_id", "text_hash", *SPAN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in group_stream(batches, 1, 512):
            column = {c: table.column(c).to_pylist() for c in ("doc_id", "open", "text_hash", "segment", "first_word", "char_start", "text")}
            parts: list[list[int]] = []
            new = set(bounds.tolist())
            for k in range(table.num_rows):
                follows = k not in new and column["text_hash"][k] == column["text_hash"][k - 1]
                if not follows:
                    parts.append([k])
                elif column["segment"][k] != column["segment"][k - 1]:
                    parts[-1].append(k)
            joined = pa.array(["".join(column["text"][i] for i in part) for part in parts], pa.large_string())
            for lo, hi in pieces(joined):
                words = word_table(joined[lo:hi])
                grams, cuts = shingle_hashes(words.hashes, words.offsets, width)
                n = np.maximum(np.diff(cuts) - least + 1, 0)
                starts = spread(cuts[:-1], n)
                if not len(starts):
                    continue
                spans = []
                for k in np.flatnonzero(n).tolist():
                    head = parts[lo + k][0]
                    s = np.arange(n[k])
                    e = s + least + width - 1
                    first, last = words.offsets[k] + s, words.offsets[k] + e - 1
                    spans.append(np.stack([np.full(n[k], column["open"][head]), np.full(n[k], column["doc_id"][head]), np.full(n[k], column["text_hash"][head]), column["first_word"][head] + s, column["first_word"][head] + e, column["char_start"][head] + words.starts[first], column["char_start"][head] + words.ends[last]]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (run_hashes(run_sums(grams), starts, least).view(np.int64), *np.concatenate(spans, axis=1))], names)

    return sorted_pieces.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def merged(spans: DataFrame) -> DataFrame:
    """Union of overlapping or touching spans of each document (separately for is_first)."""
    key = ["doc_id", "text_hash", "is_first"]
    # equal spans first: what many documents share is one span of its source
    spans = spans.groupBy(*key, "first_word", "end_word").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("source").alias("source"))
    whole = united(spans, key, "first_word", "end_word", F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("source").alias("source"))
    return whole.withColumn("n_words", F.col("end_word") - F.col("first_word")).drop("end_word")


def both_ends(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, is_first, places, source: the later and the earlier occurrence of each passage."""
    later = found.select("doc_id", "text_hash", F.lit(False).alias("is_first"), *SPAN, "source", "exact")
    earlier = found.select(F.col("source").alias("doc_id"), F.col("source_hash").alias("text_hash"), F.lit(True).alias("is_first"), *(F.col(f"source_{c}").alias(c) for c in SPAN), "source", F.lit(0).cast("long").alias("exact"))
    return later.unionByName(earlier)


def repeated_passages(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    least = words - width + 1
    if least < 4:
        raise ValueError(f"passages need at least {width + 3} words")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        shared = materialize(shared_windows(base, width, least), "windows", compression="zstd")
        found = materialize(regions(meetings(shared), width, least), "regions", compression="zstd")
        passages = materialize(compare(found, fetch(base, sides(found)), width, least, similarity), "passages", compression="zstd")
        discard(found)
        later = materialize(regions(later_meetings(shared, passages, width, least), width, least), "regions", compression="zstd")
        wanted = materialize(missed(shared, passages, width, least), "missed", compression="zstd")
        texts = materialize(fetch(base, sides(later).unionByName(wanted.drop("open"))), "texts", compression="zstd")
        passages = passages.unionByName(materialize(compare(later, texts.filter("id >= 0"), width, least, similarity), "passages", compression="zstd"))
        runs = materialize(exact_runs(wanted, texts.filter("id < 0"), width, least), "runs", compression="zstd")
        discard(texts)
        crowd = materialize(crowds(shared, passages, width, least), "crowds", compression="zstd")
        discard(shared)
        met = materialize(near_sources(with_surroundings(base, cells(crowd), width), least, similarity), "met", compression="zstd")
        discard(crowd)
        met = met.withColumn("place", F.shiftright("at", 2 * _REACH + _FUNCTION))
        for first, most in RANKS:  # a place that a passage covers by now needs no other source
            rest = uncovered(met.filter(F.size("source") >= first), passages, width, least).filter("open") if first > 1 else met
            passages = passages.unionByName(compared(base, regions(each_source(rest, first, most), width, least, 1), width, least, similarity))
        place = ("doc_id", "text_hash", *SPAN)
        first = runs.groupBy("key").agg(F.min(F.struct(*place)).alias("lead"), F.max("doc_id").alias("last")).filter("lead.doc_id < last")
        more = runs.filter("open = 1").join(first, "key").filter("doc_id > lead.doc_id").select(*place, F.col("lead.doc_id").alias("source"), F.col("lead.text_hash").alias("source_hash"), *(F.col(f"lead.{c}").alias(f"source_{c}") for c in SPAN), F.lit(1).cast("long").alias("exact"))
        result = merged(both_ends(passages.unionByName(more)))
        return keep(result.select("doc_id", "first_word", "n_words", "char_start", "char_end", "source", "is_first", "text_hash"), "repeats")


def cut(docs: DataFrame, passages: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the passages that repeat an earlier one; rows of which nothing is left go. Other columns stay."""
    places = passages.filter("not is_first").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("char_start", "char_end")).alias("cuts"))
    schema = docs.schema
    names = schema.names
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, texts, keep = batch.column(len(names)).to_pylist(), batch.column(at).to_pylist(), []
            for k, own in enumerate(cuts):
                if own and texts[k] is not None:
                    t, out, end = texts[k], [], 0
                    for a, b in sorted((c["char_start"], c["char_end"]) for c in own):
                        out.append(t[end:a])
                        end = max(end, b)
                    texts[k] = "".join([*out, t[end:]])
                keep.append(not own or texts[k] is None or bool(texts[k].strip()))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    own, hashed, cuts = (free_name(docs, n) for n in ("cut_id", "cut_hash", "cuts"))
    ids = places.select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed), F.col("cuts").alias(cuts))
    joined = docs.join(ids, (F.col(doc_id).cast("long") == F.col(own)) & (F.xxhash64(F.col(text).cast("string")) == F.col(hashed)), "left").drop(own, hashed)
    return joined.mapInArrow(lean(run), schema)
