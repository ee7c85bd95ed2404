"""Jaccard join against brute force over all pairs of documents."""

import random

from pyspark.sql import functions as F

from tidemark.llm import jaccard_join
from tidemark.llm.common import normal_word
from tidemark.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def shingles(text, width=5):
    w = [x for x in map(normal_word, (text or "").split()) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, threshold=0.8):
    """doc number -> (class, links) for a list of (id, text)."""
    sets = [shingles(t) if i is not None else set() for i, t in docs]
    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    links, parent = [0] * len(docs), list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, s in enumerate(sets):
        common = {}
        for x in s:
            for o in index[x]:
                if o < k:
                    common[o] = common.get(o, 0) + 1
        for o, n in common.items():
            if n >= threshold * (len(s) + len(sets[o]) - n) - 1e-9:
                links[k] += 1
                links[o] += 1
                parent[root(k)] = root(o)
    low = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            low[root(k)] = min(i, low.get(root(k), i))
    return sorted((i if i is not None else -1, low.get(root(k), -1) if sets[k] else (i if i is not None else -1), links[k]) for k, (i, _) in enumerate(docs))


def rows_of(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in df.collect())


def test_op5_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    assert rows_of(QUERIES["op5_jaccard_join"](spark, SF01)) == brute(docs)


def test_op5_large_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "GROUP", 16)
    rng = random.Random(1)
    base = [rng.choices([f"w{i}" for i in range(300)], k=80) for _ in range(6)]
    docs = []
    for n in range(420):
        w = list(base[n % 2 if n < 300 else n % 6])
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(80)] = f"x{rng.randrange(50)}"
        docs.append((n, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "!!"), (503, "a b"), (504, "A, b."), (505, "a b c"), (None, docs[0][1]), (None, None), (7, docs[7][1]), (8, docs[9][1]), (600, "long " * 20_000 + docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"set_id": F.lit("clash"), "n": F.lit(None).cast("int")})
    assert rows_of(jaccard_join.near_duplicates(df)) == brute(docs)
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_op5_chain_of_near_copies(spark, monkeypatch):
    """Each document is near to its neighbours only: one class, few links, and only surviving pairs are verified."""
    rng = random.Random(2)
    words = rng.choices([f"w{i}" for i in range(500)], k=100)
    docs = []
    for n in range(150):
        words[rng.randrange(100)] = f"x{n}"
        docs.append((n, " ".join(words)))
    want = brute(docs)
    assert {c for _, c, _ in want} == {0} and max(n for *_, n in want) < 20
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = rows_of(jaccard_join.near_duplicates(df))
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "GROUP", 8)  # the chain is larger: by buckets
    assert whole == want and rows_of(jaccard_join.near_duplicates(df)) == want
    with jaccard_join.scratch(spark):
        sets = jaccard_join.sketch(df, 5).select("set_id", "sig")
        survivors = jaccard_join.surviving_members(sets, 0.8).groupBy("home", "x", "y").count().collect()
    pairs = sum(n for *_, n in want) // 2
    assert sum(r["count"] for r in survivors) <= 12 * pairs  # not a copy of each set for each block of the chain


def test_pruning_keeps_the_threshold():
    least = jaccard_join.least_matches(0.8)
    assert list(least) == [20, 40, 60, 80, 100, 120] and all(m < 0.8 * t for t, m in least.items()) and least[120] > 60
