"""Suffix arrays and the removal of repeated strings, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_groups import lyndon_groups, suffix_array


def layout(words):
    return np.array([0] + [x for w in words for x in (*w, 0)])


def rest(symbols, k):
    out = []
    while symbols[k]:
        out.append(symbols[k])
        k += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=4))
def test_suffix_array(words):
    symbols = layout(words)
    order = suffix_array(symbols)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    ends = int((symbols == 0).sum())
    assert not symbols[order[:ends]].any()
    suffixes = [rest(symbols, k) for k in order[ends:]]
    assert suffixes == sorted(suffixes)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=30))
def test_groups_are_lyndon_prefixes(word):
    symbols = layout([word])
    group, length, floor = lyndon_groups(symbols, 1)
    n = len(word)
    smaller = [next((j for j in range(i + 1, n) if word[j:] < word[i:]), n) for i in range(n)]
    assert length[1 : n + 1].tolist() == [smaller[i] - i for i in range(n)] and floor == 2
    prefixes = [word[i : smaller[i]] for i in range(n)]
    firsts = {tuple(p): 2 + sum(q < p for q in prefixes) for p in prefixes}
    assert group[1 : n + 1].tolist() == [firsts[tuple(p)] for p in prefixes]


def test_long_suffix_arrays():
    rng = np.random.default_rng(3)
    for word in ([1] * 3000 + [2], [2] * 3000 + [1], [1, 2] * 1500, rng.integers(1, 3, 5000).tolist(), [*range(1, 2000)]):
        symbols = layout([word])
        key = np.array(word, np.int32).astype(">i4").tobytes()
        want = sorted(range(len(word)), key=lambda k: key[4 * k :])
        assert (suffix_array(symbols)[2:] - 1).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ü", max_size=60), max_size=6), st.sampled_from([(8, 1 << 19), (8, 16), (3, 10), (1, 5), (2, 7)]))
def test_pieces_cover_each_string_once(texts, shape):
    length, size = shape
    old, suffix_dedup.SLICE = suffix_dedup.SLICE, size
    try:
        found = list(suffix_dedup.find_pieces(pa.array(texts, pa.large_string()), length))
    finally:
        suffix_dedup.SLICE = old
    width = suffix_dedup.anchor_width(length)
    seen, anchors, wholes = [], {}, {}
    for p in found:
        for row, at, before, more, anchor, whole in zip(p.row.tolist(), p.at.tolist(), p.before.tolist(), p.more.tolist(), p.anchor.tolist(), p.whole.tolist(), strict=True):
            data = texts[row].encode()
            seen += [(row, at + k) for k in range(more + 1)]
            assert more <= before <= length - width
            assert anchors.setdefault(data[at + before : at + before + width], anchor) == anchor
            assert wholes.setdefault((data[at : at + more + length], before, more), whole) == whole
    assert sorted(seen) == [(r, k) for r, t in enumerate(texts) for k in range(len(t.encode()) - length + 1)]
    assert len(set(anchors.values())) == len(anchors) and len(set(wholes.values())) == len(wholes)


def brute(rows, length):
    """Spans and left bytes of each (key, text), judged in order."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if data[k : k + length] in seen:
                covered[k : k + length] = True
            seen.add(data[k : k + length])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(int)))
        out[key] = [tuple(e) for e in edges.reshape(-1, 2).tolist()], data[~covered] if isinstance(data, np.ndarray) else bytes(np.frombuffer(data, np.uint8)[~covered])
    return out


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(30))
    texts = []
    for k in range(60):
        own = " ".join(word() for _ in range(rng.randint(0, 40)))
        begin = rng.randrange(0, len(passage) // 2)
        texts.append(rng.choice([own, own + passage + own, passage[begin:] + own, own[:20] + passage[: len(passage) - begin], texts[-1] if texts else own, "xy" * rng.randint(0, 60), passage]))
    return texts


@pytest.mark.parametrize(("limit", "length"), [(8192, 100), (3, 100), (2, 9), (8192, 30)])
def test_against_every_string(spark, limit, length):
    texts = [None, "", "short", *planted(limit + length)]
    rows = [(7 * k - 50, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, length)
    got = suffix_dedup.remove_repeats(docs, length=length, limit=limit).collect()
    assert {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in got} == want
    assert all(r.n_bytes == len((t or "").encode()) for r, (_, t) in zip(sorted(got), rows, strict=True))
    assert any(s for s, _ in want.values())


def test_hot_passage_is_split(spark):
    """One passage in all documents, with other words around it: its anchors have more different pieces than the limit."""
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows = [(k, "".join(rng.choice("xyz ") for _ in range(90)) + passage + "".join(rng.choice("uvw ") for _ in range(90))) for k in range(120)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), limit=10).collect()
    want = brute(rows, 100)
    assert {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in got} == want
    assert all(s for k, (s, _) in want.items() if k)


def test_edges(spark):
    text, other = "the same words in both of them, " * 5, "completely other words here, " * 5
    rows = [(None, text, 1), (3, text, 2), (3, text, 3), (4, text, 4), (None, other, 5), (None, other, 6), (9, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumnRenamed("spans", "n_bytes")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, len(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    n, inner, period = len(text), 32 + 99, len(other)
    # both rows of document 3 are one document, as are the two with null ids and equal texts; all texts repeat themselves
    assert got == [(False, 3, n, len(brute([(0, text)], 100)[0][1])), (False, 3, n, len(brute([(0, text)], 100)[0][1])), (False, 4, n, 0), (False, 9, 0, 0)] + sorted(
        [(True, 0, n, 0)] + 2 * [(True, 0, period, len(brute([(0, other)], 100)[0][1]))]
    )
    assert inner < n
    empty = suffix_dedup.remove_repeats(docs.limit(0))
    assert empty.columns == ["doc_id", "n_bytes", "spans", "kept"] and empty.count() == 0


def test_one_id_with_two_texts(spark):
    one, two = "first text of this id, with its own words and then the shared ones: ", "second text of this id, which has other words before the shared ones: "
    shared = "words that both of the two texts have at their ends, and that are more than one hundred bytes long in each of them"
    docs = spark.createDataFrame([(5, one + shared), (5, two + shared)], "doc_id long, text string")
    got = {r.n_bytes: len(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()}
    common = len(shared) + 2  # ": " belongs to it
    assert sorted(n - kept for n, kept in got.items()) in ([0, common], [0, common + len("the shared ones")], [0, common + len(" the shared ones")])
