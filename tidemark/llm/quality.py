"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over
the counts of vote patterns (at most 3 ** labellers rows, counted over all documents) estimates each
labeller's accuracy and the share of good documents. The posterior labels of a bounded sample train a linear
scorer on hashed words, which then scores every whole text.

Null and empty texts get no vote but `too short`, which is bad, and a score from the bias alone. Repeated
rows are scored alike. Only the named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import char_slices, code_points, mix, pieces, strings, word_hashes

#: Dimensions of the scorer.
WEIGHTS_LOG2 = 18
#: Documents that train the scorer, about; passes over them; step size; pull towards zero.
SAMPLE, PASSES, STEP, DECAY = 8_000, 5, 0.5, 1e-5
ROUNDS = 100


def labellers(text: Column) -> dict[str, Column]:
    """Votes 1 (good), -1 (bad) or 0 (nothing), from built-in functions only."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    count = lambda chars: n - F.length(F.translate(t, chars, ""))
    words = F.size(F.split(F.trim(t), " "))
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    symbols = share(count("|#$%&*!<>{}[]=_~^\\"), words)
    upper = share(count("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÓÍÁÚ"), n)
    stops = share(count(".?!"), words)
    commas = share(count(","), words)
    letters = share(n - count("0123456789|#$%&*!<>{}[]=_~^\\@/"), n)
    distinct = share(F.size(F.array_distinct(F.split(F.lower(t), " "))), words)
    length = share(n, words)

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    long_enough = words >= 20
    return {
        "symbols": vote(symbols < 0.05, symbols > 0.3),
        "upper": vote(long_enough & (upper < 0.08), upper > 0.3),
        "stops": vote(long_enough & stops.between(0.02, 0.35), long_enough & ((stops < 0.005) | (stops > 0.6))),
        "commas": vote(long_enough & commas.between(0.005, 0.2), long_enough & (commas > 0.5)),
        "letters": vote(letters > 0.97, letters < 0.9),
        "distinct": vote((words >= 50) & (distinct > 0.35), (words >= 50) & (distinct < 0.12)),
        "length": vote(length.between(4, 9), (length < 2.5) | (length > 15)),
        "size": vote(words >= 50, words < 3),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior chance of `good` for each vote pattern, and tables (label, labeller, vote + 1) of the chances of
    each vote among those given.

    Labellers are taken as independent given the label. Starts from the votes' majority; ends when the
    likelihood stands still or after ROUNDS.
    """
    n, k = patterns.shape
    good = np.clip(0.5 + 0.45 * np.sign(patterns.sum(axis=1)), 0.05, 0.95)
    chance = np.full((2, k, 3), 1 / 3)
    before = -np.inf
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        for v in (0, 2):
            chance[:, :, v] = weight @ (patterns == v - 1) + 1
        chance[:, :, 1] = 0
        chance /= chance.sum(axis=2, keepdims=True)
        chance[:, :, 1] = 1  # no vote tells nothing
        logs = np.log(prior)[:, None] + np.stack([np.log(chance[y, np.arange(k), patterns + 1]).sum(axis=1) for y in range(2)])
        top = logs.max(axis=0)
        total = top + np.log(np.exp(logs - top).sum(axis=0))
        good = np.exp(logs[1] - total)
        if abs((likelihood := float(counts @ total)) - before) < 1e-9 * abs(likelihood):
            break
        before = likelihood
    return good, chance


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value: words and pairs of neighbours of a raw text's white-space runs, hashed; counts
    divided by the root of the sum of squares."""
    out_rows, out_dims, out_values = [], [], []
    words, offsets, _ = word_hashes(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    shape = raw_shapes(texts)
    for r, h in ((row, words), shape):
        key = (r.astype(np.int64) << WEIGHTS_LOG2) | (mix(h, 11) >> np.uint64(64 - WEIGHTS_LOG2)).astype(np.int64)
        key, n = np.unique(key, return_counts=True)
        r, value = key >> WEIGHTS_LOG2, np.sqrt(n.astype(np.float64))
        norm = np.sqrt(np.bincount(r, value**2, minlength=len(texts)))
        out_rows.append(r)
        out_dims.append(key & ((1 << WEIGHTS_LOG2) - 1))
        out_values.append(value / norm[r])
    return np.concatenate(out_rows), np.concatenate(out_dims), np.concatenate(out_values)


def raw_shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each character class seen at word ends and starts: how a text is written."""
    out_rows, out_classes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for rows, parts in char_slices([f" {t} " for t in texts.to_pylist()], 2):
        small = np.minimum(code_points(parts), 255)
        part = np.repeat(np.arange(len(parts)), list(map(len, parts)))
        row, space, classes = np.array(rows)[part], small <= 32, CLASSES[small]
        one = part[1:] == part[:-1]
        ends = np.flatnonzero(space[1:] & ~space[:-1] & one)
        starts = np.flatnonzero(space[:-1] & ~space[1:] & one) + 1
        out_rows += [row[ends], row[starts]]
        out_classes += [classes[ends] + np.uint64(1000), classes[starts] + np.uint64(2000)]
    return np.concatenate(out_rows), np.concatenate(out_classes)


def _classes() -> np.ndarray:
    """One class for lower-case letters, one for capitals, one for digits, each other character its own."""
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 + ord(c)
    return np.array([kind(chr(i)) for i in range(256)], np.uint64)


CLASSES = _classes()


def train(samples: Iterator[tuple[pa.Array, np.ndarray]]) -> np.ndarray:
    """Weights (the last is the bias) from batches of texts and soft labels: AdaGrad over logistic loss."""
    rows, dims, values, labels, n = [], [], [], [], 0
    for texts, soft in samples:
        r, d, v = features(texts)
        rows.append(r + n)
        dims.append(d.astype(np.int32))
        values.append(v.astype(np.float32))
        labels.append(soft)
        n += len(texts)
    weights, squares = np.zeros((1 << WEIGHTS_LOG2) + 1), np.full((1 << WEIGHTS_LOG2) + 1, 1e-6)
    if not n:
        return weights
    row, dim, value, label = (np.concatenate(x) for x in (rows, dims, values, labels))
    order = np.argsort(row, kind="stable")
    row, dim, value = row[order], dim[order], value[order]
    bounds = np.searchsorted(row, np.arange(n + 1))
    step = 256
    for _ in range(PASSES):
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            part = slice(bounds[lo], bounds[hi])
            score = np.bincount(row[part] - lo, weights[dim[part]] * value[part], minlength=hi - lo) + weights[-1]
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - label[lo:hi]
            touched, place = np.unique(dim[part], return_inverse=True)
            slope = np.bincount(place, error[row[part] - lo] * value[part], minlength=len(touched)) / (hi - lo) + DECAY * weights[touched]
            squares[touched] += slope**2
            weights[touched] -= STEP * slope / np.sqrt(squares[touched])
            squares[-1] += error.mean() ** 2
            weights[-1] -= STEP * error.mean() / np.sqrt(squares[-1])
    return weights


def classify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, weak_label (posterior of the votes), score (of the linear scorer) and keep (score >= least)."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    votes = labellers(F.col("text"))
    names = list(votes)
    packed = sum(((v + 1) * 3**i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    voted = base.withColumn("pattern", packed)
    found = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers rows
    codes = np.array(sorted(r.pattern for r in found), np.int64)
    counts = np.array([n for _, n in sorted((r.pattern, r.n) for r in found)], np.float64)
    patterns = codes[:, None] // 3 ** np.arange(len(names)) % 3 - 1
    posterior = np.full(3 ** len(names), 0.5)
    if len(codes):
        posterior[codes] = estimate(patterns, counts)[0]
    total = int(counts.sum())

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def samples():
            for batch in batches:
                texts, soft = strings(batch.column(0)), posterior[batch.column(1).to_numpy()]
                for lo, hi in pieces(texts):
                    yield texts[lo:hi], soft[lo:hi]

        yield pa.RecordBatch.from_arrays([pa.array([train(samples()).astype("<f4").tobytes()], pa.binary())], ["weights"])

    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1)))
    # a bounded sample, in one task by intent; repeats of one row are learned from once
    chosen = voted.filter(picked).select("text", "pattern").distinct().coalesce(1).sortWithinPartitions(F.xxhash64("text"))
    trained = chosen.mapInArrow(fit, "weights binary").collect()
    weights = np.frombuffer(trained[0].weights, "<f4").astype(np.float64) if trained else np.zeros((1 << WEIGHTS_LOG2) + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(1))
            out = []
            for lo, hi in pieces(texts):
                row, dim, value = features(texts[lo:hi])
                out.append(1 / (1 + np.exp(-np.clip(np.bincount(row, weights[dim] * value, minlength=hi - lo) + weights[-1], -30, 30))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior[batch.column(2).to_numpy()]), pa.array(scores), pa.array(scores >= least)], ["doc_id", "weak_label", "score", "keep"])

    return voted.select("doc_id", "text", "pattern").mapInArrow(score, "doc_id long, weak_label double, score double, keep boolean")
