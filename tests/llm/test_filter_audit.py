"""The filter audit, its matrix and its dictionary against plain Python."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB é\t\n\x0b\x0c\r\x1c\x85 ", max_size=12), max_size=8))
def test_words_and_rows(texts):
    words, row = filter_audit.words_of(pa.array(texts, pa.large_string()))
    want = [(k, w) for k, t in enumerate(texts) for w in WORD.findall(t)]
    assert list(zip(row.tolist(), words.to_pylist(), strict=True)) == want
    coded = words.dictionary_encode()
    bounds, columns, counts = filter_audit.compressed_rows(row, coded.indices.to_numpy().astype(np.int64), len(texts))
    dictionary = coded.dictionary.to_pylist()
    for k in range(len(texts)):
        cells = {dictionary[c]: n for c, n in zip(columns[bounds[k] : bounds[k + 1]], counts[bounds[k] : bounds[k + 1]], strict=True)}
        assert cells == Counter(w for r, w in want if r == k)


def test_matrix_has_global_columns(spark):
    texts = ["a b a", "", "c  b\ta", " a ", "d" * 50, "b", "a a a a"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    matrix, dictionary = filter_audit.document_term_matrix(rows)
    terms = {r.word: r.term for r in dictionary.collect()}
    assert len(set(terms.values())) == len(terms) and set(terms) == {"a", "b", "c", "d" * 50}
    seen = {}
    for shard in matrix.collect():
        bounds, counts = (np.frombuffer(x, np.int32).tolist() for x in (shard.bounds, shard.counts))
        columns = np.frombuffer(shard.terms, np.int64).tolist()
        for k, row in enumerate(shard.attributes):
            part = slice(bounds[k], bounds[k + 1])
            seen[row.doc_id] = dict(zip(columns[part], counts[part], strict=True))
    assert seen == {k: dict(Counter(terms[w] for w in WORD.findall(t))) for k, t in enumerate(texts)}
    counts = {r.doc_id: (r.n_words, r.n_distinct) for r in filter_audit.row_counts(rows).collect()}
    assert counts == {k: (len(WORD.findall(t)), len(set(WORD.findall(t)))) for k, t in enumerate(texts)}


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    judged = []
    for doc_id, text, source in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": any(d[0] is not None and doc_id is not None and d[0] < doc_id and (d[1] or "") == text for d in docs),
        }
        judged.append((source or "", doc_id, fails))
    out = {}
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        removed_by = Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[2][f]]
                failing = [j for j in own if j[2][f]]
                left = [j for j in left if not j[2][f]]
                removed_by[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(j[2].values()) == 1 for j in failing), sum(j[1] in good for j in gone), sum(j[1] in toxic for j in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_against_all_orders(spark):
    long_text = " ".join(f"word{k}" for k in range(230))
    few = "same words again and again " * 60
    docs = [(1, long_text, "x"), (2, long_text, "x"), (3, few, "x"), (4, few + "#", "y"), (5, "SHOUTED WORDS", "y"), (6, None, None), (7, "", "y"), (None, long_text, "x"), (None, None, "z")]
    docs += [(8, long_text + " A|B" * 9, "x"), (9, few + "#", "x"), (9, few, "x"), (9, few, "x"), (10, "é" * 300 + " AB", None), (2, long_text, "x")]
    labels = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, None), (5, 1, None), (9, 0, 0), (9, 1, 0), (99, 1, 1), (None, 1, 1), (8, None, 1)]
    table = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, source string, n int, part string").repartition(4)
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute(docs, [x for x in labels if x[0] is not None])
    assert len(got) == len(want) == 4 * 120 * 5
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], docs.schema)
    got = filter_audit.audit(one, labels).collect()
    assert len(got) == 600 and {r.shapley for r in got if r.filter_order[r.step - 1] == "A"} == {120}


def test_op13_shards_are_small(spark):
    """Shards are stored and then shuffled as they are: a cell of the matrix takes few bytes there, and its numbers come back."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(400)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    (shard,) = filter_audit._local_shards(docs, "text").collect()
    cells = sum(len(set(t.split())) for t in texts)
    assert len(shard.bounds) + len(shard.columns) + len(shard.counts) < 4 * cells
    matrix, _ = filter_audit.document_term_matrix(docs)
    (row,) = matrix.collect()
    bounds, counts = np.frombuffer(row.bounds, np.int32), np.frombuffer(row.counts, np.int32)
    assert np.diff(bounds).tolist() == [len(set(t.split())) for t in texts] and len(row.terms) == 8 * cells and counts.sum() == 400 * len(texts)
