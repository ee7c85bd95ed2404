"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, for each of SLOTS places, one bit a language; an n-gram's HASHES places
and-ed together give all languages that contain it. A document's hits of each language are counted over all
its n-grams, the number expected from false positives is taken off, and the language with most left wins.

Learning counts the n-grams of a bounded sample of the labelled texts (about `sample` documents a language,
picked by a hash of the text) and keeps an n-gram for a language when it is frequent enough there. A text that
is null or has no letter is `und` with score 0. A text with letters whose n-grams are all unknown gets the
language with most labelled documents and score 0; one without any n-gram (a single letter) gets it with an even
chance. Whole texts are used, long ones in slices. Any number of languages
is learned: a slot has a mask word for each MASK_BITS of them. Repeated rows and extra columns don't matter. With no
labelled row there is no language to learn, and every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import char_slices, code_points, discard, lean, materialize, mix, pieces, strings

WIDTH = 4
SLOTS_LOG2 = 22
HASHES = 3
#: Labelled documents a language that learning uses, about.
SAMPLE = 20_000
#: An n-gram belongs to a language from so many occurrences and this share of the rate in its best language.
LEAST_COUNT, LEAST_RATE = 3, 0.1
#: Languages of one mask word.
MASK_BITS = 62
NONE = "und"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # most labelled documents first
    filters: list[np.ndarray]  # bitmasks of languages for each slot: one array for each mask word
    false_rates: np.ndarray  # chance that an n-gram of no language hits each one

    def masks(self, grams: np.ndarray) -> list[np.ndarray]:
        """The languages of each n-gram, as mask words."""
        slots = [_slot(grams, k) for k in range(HASHES)]
        return [reduce(np.bitwise_and, [word[s] for s in slots]) for word in self.filters]

    def holds(self, masks: list[np.ndarray], language: int) -> np.ndarray:
        word, bit = divmod(language, MASK_BITS)
        kind = masks[word].dtype.type
        return (masks[word] >> kind(bit) & kind(1)).astype(bool)


def _slot(grams: np.ndarray, k: int) -> np.ndarray:
    return (mix(grams, k + 1) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int32)


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of all runs of WIDTH characters of each text (lower case, what is no letter is a space) and the row of
    each, in portions. Runs with two spaces side by side are left out."""
    for rows, parts in char_slices([f" {t.lower()} " for t in texts.to_pylist()], WIDTH):
        code = code_points(parts)
        known = np.unique(code)
        letter = np.fromiter((chr(c).isalpha() for c in known.tolist()), bool, len(known))
        code = np.where(letter[np.searchsorted(known, code)] if len(known) > 256 else _flags(known, letter)[code], code, 0).astype(np.uint64)
        part = np.repeat(np.arange(len(parts)), list(map(len, parts)))
        n = max(len(code) - WIDTH + 1, 0)
        gram = np.zeros(n, np.uint64)
        for k in range(WIDTH):
            gram = gram << np.uint64(16) ^ gram >> np.uint64(48) ^ code[k : k + n]
        blank = code == 0
        keep = part[:n] == part[WIDTH - 1 :] if n else np.empty(0, bool)
        for k in range(WIDTH - 1):
            keep &= ~(blank[k : k + n] & blank[k + 1 : k + 1 + n])
        yield gram[keep], np.array(rows)[part[:n][keep]]


def _flags(known: np.ndarray, letter: np.ndarray) -> np.ndarray:
    out = np.zeros(int(known[-1]) + 1 if len(known) else 1, bool)
    out[known[letter]] = True
    return out


def learn(labelled: DataFrame, *, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows of labelled whose language is not null."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    sizes = sorted(((r["count"], r.lang) for r in rows.groupBy("lang").count().collect()), key=lambda x: (-x[0], x[1]))
    languages = tuple(name for _, name in sizes)
    kind = np.uint8 if len(languages) <= 8 else np.int64
    filters = [np.zeros(1 << SLOTS_LOG2, kind) for _ in range(-(-len(languages) // MASK_BITS))]
    if not languages:
        return Model(languages, filters, np.zeros(0))
    number = {name: i for i, name in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for n, name in sizes for x in (name, min(1.0, sample / n))])
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")] * F.lit(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = strings(batch.column(0)), np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi in pieces(texts):
                for grams, row in ngrams(texts[lo:hi]):
                    of = langs[lo:hi][row]
                    for i in np.unique(of).tolist():
                        g, n = np.unique(grams[of == i], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), i), pa.int32()), pa.array(n, pa.int64())], ["gram", "lang", "n"])

    counted = picked.mapInArrow(lean(count), "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "ngrams", compression="zstd")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.create_map(*[F.lit(x) for k, v in (totals or {0: 1}).items() for x in (k, float(v))])[F.col("lang")]
    grams = counted.withColumn("rate", rate).groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "n", "rate")).alias("of"))
    often = F.filter("of", lambda x: (x["n"] >= LEAST_COUNT) & (x["rate"] >= F.col("best") * LEAST_RATE))
    known = grams.select("gram", F.explode(F.transform(often, lambda x: x["lang"])).alias("lang"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, lang = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().astype(np.int64)
            places = np.concatenate([_slot(g, k) for k in range(HASHES)])
            word, mask = lang // MASK_BITS, np.int64(1) << lang % MASK_BITS
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.tile(word, HASHES)), pa.array(np.tile(mask, HASHES))], ["slot", "word", "mask"])

    # at most 2 ** SLOTS_LOG2 rows a mask word, whatever the corpus
    table = known.mapInArrow(lean(slots), "slot int, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    discard(counted)
    slot, word, mask = (table[c].to_numpy() for c in ("slot", "word", "mask"))
    for k, words in enumerate(filters):
        words[slot[word == k]] = mask[word == k].astype(kind)
    model = Model(languages, filters, np.zeros(len(languages)))
    fill = np.array([np.count_nonzero(model.holds(filters, i)) for i in range(len(languages))]) / (1 << SLOTS_LOG2)
    return Model(languages, filters, fill**HASHES)


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep`, language and score (under `names`) of each document; only the text decides."""
    out_names = names

    at = keep.index(text) if text in keep else len(keep)  # a kept text is sent once

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(at))
            found, scores = [], []
            for lo, hi in pieces(texts):
                lettered = [any(map(str.isalpha, t)) for t in texts[lo:hi].to_pylist()]
                n, hits = np.zeros(hi - lo), np.zeros((len(model.languages), hi - lo))
                for grams, row in ngrams(texts[lo:hi]):
                    n += np.bincount(row, minlength=hi - lo)
                    masks = model.masks(grams)
                    for i in range(len(model.languages)):
                        hits[i] += np.bincount(row[model.holds(masks, i)], minlength=hi - lo)
                rates = model.false_rates[:, None]
                real = np.maximum((hits - n * rates) / (1 - rates), 0)
                total = real.sum(axis=0)
                best = real.argmax(axis=0) if len(real) else np.zeros(hi - lo, int)
                even = np.where(n == 0, 1 / max(1, len(model.languages)), 0.0)
                score = np.divide(real.max(axis=0, initial=0), total, out=even, where=total > 0)
                for k in range(hi - lo):
                    known = lettered[k] and len(model.languages) > 0
                    found.append(model.languages[best[k]] if known else NONE)
                    scores.append(float(score[k]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, *out_names])

    types = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{out_names[0]}` string, `{out_names[1]}` double"
    inputs = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    inputs += [F.col(text).cast("string").alias("text")] if text not in keep else []
    return docs.select(*inputs).mapInArrow(lean(decide), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is for testing: crc32 of the id's text is divisible by 5 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out())
