"""Shared helpers against plain loops."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common


def roots(n, edges):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)] + [(3, 3)]
    want = roots(800, edges)
    got = {r.id: r.home for r in common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert set(got) == {v for a, b in edges if a != b for v in (a, b)}
    groups = {}
    for v, home in got.items():
        groups.setdefault(home, set()).add(want[v])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len({want[v] for v in got})
    assert common.components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 20))
def test_group_stream(keys, size):
    keys = sorted(keys)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7], pa.int64())], ["k"]) for i in range(0, len(keys), 7)]
    seen = []
    for table, bounds in common.group_stream(iter(batches), 1, size):
        column = table.column(0).to_pylist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            assert len(set(column[a:b])) == 1
            seen.append((column[a], b - a))
    assert seen == [(k, keys.count(k)) for k in sorted(set(keys))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=8))
def test_pairs_in_groups(sizes):
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got = sorted((int(a), int(b)) for i, j in common.pairs_in_groups(bounds, 5) for a, b in zip(i, j))
    assert got == sorted((a, b) for lo, hi in zip(bounds[:-1], bounds[1:]) for a in range(lo, hi) for b in range(a + 1, hi))


def test_words():
    texts = pa.array(["It's  a-b, !!\n C", "", "x"], pa.large_string())
    words, offsets, places = common.word_hashes(texts)
    assert offsets.tolist() == [0, 3, 3, 4] and places.tolist() == [0, 1, 3, 0]
    again, _, _ = common.word_hashes(pa.array(["its AB c"], pa.large_string()))
    assert words[:3].tolist() == again.tolist()


def test_word_places_after_leading_white_space():
    texts = [" foo bar", "\n\r\n a -- b ", "", "   ", "c", "\u3000\x1c\x85d e"]
    for part in (pa.array(texts, pa.large_string()), pa.array(["x", *texts], pa.large_string())[1:]):
        _, offsets, places = common.word_hashes(part)
        for k, t in enumerate(texts):
            runs = t.split()
            assert [runs[p] for p in places[offsets[k] : offsets[k + 1]]] == [w for w in runs if common.normal_word(w)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB1 _-.\n\t\x1c\u3000\xa0ßİıΣςσÄé\u0301日𝒳"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
def test_word_table_equals_plain_words(texts):
    found = common.word_table(pa.array(texts, pa.large_string()))
    hash_of = {}
    for k, text in enumerate(texts):
        runs = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        want = [(w, p, a, b) for p, (a, b) in enumerate(runs) if (w := common.normal_word(text[a:b]))]
        own = slice(found.offsets[k], found.offsets[k + 1])
        assert list(zip(found.places[own].tolist(), found.starts[own].tolist(), found.ends[own].tolist())) == [w[1:] for w in want]
        for (w, *_), h in zip(want, found.hashes[own].tolist(), strict=True):
            assert hash_of.setdefault(w, h) == h
    assert len(set(hash_of.values())) == len(hash_of)


def test_long_words_of_two_letters_differ():
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(set(common.word_table(pa.array([f"{a} {b} {a[:300]} {b[:300]}"], pa.large_string())).hashes.tolist())) == 4


def test_lean_tasks_drop_what_tokenizers_remember():
    from tidemark.llm import tokens

    tokens._encoders["a vocabulary"] = object()
    batches = [pa.RecordBatch.from_pydict({"x": [1, 2]}), pa.RecordBatch.from_pydict({"x": [3]})]
    assert list(common.lean(lambda own: (b.slice(1) for b in own))(iter(batches))) == [b.slice(1) for b in batches]
    assert "a vocabulary" not in tokens._encoders
