"""Substring dedup against brute force over all runs of 50 words."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import substring_dedup
from tidemark.llm.common import normal_word
from tidemark.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"


def words(text):
    return [w for w in map(normal_word, (text or "").split()) if w]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), min_size=1, max_size=5), st.integers(2, 12))
def test_compact_windows(rows, least):
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.array(sum(rows, []), np.uint32) + 1
    want = set()
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            lo = hi = c
            while lo and row[lo - 1] > v:
                lo -= 1
            while hi + 1 < len(row) and row[hi + 1] >= v:
                hi += 1
            if hi - lo + 1 >= least:
                want.add(tuple(int(x + offsets[r]) for x in (lo, c, hi)))
    assert set(zip(*(x.tolist() for x in substring_dedup.compact_windows(flat, offsets, least)))) == want


def exact_repeats(docs, n=50):
    """doc -> word places that lie in a run of n words which a document with a smaller id has too; and all docs with shared runs."""
    first, later, shared = {}, {}, set()
    for i, t in sorted(docs):
        w = words(t)
        for s in range(len(w) - n + 1):
            run = tuple(w[s : s + n])
            if (o := first.setdefault(run, i)) != i:
                later.setdefault(i, set()).update(range(s, s + n))
                shared |= {o, i}
    return later, shared


def check_against(docs, rows):
    later, shared = exact_repeats(docs)
    text = dict(docs)
    got = {}
    for r in rows:
        assert r.n_words >= 50 and (r.source == r.doc_id) == r.is_first
        piece = words(text[r.doc_id][r.char_start : r.char_end])
        assert piece == words(text[r.doc_id])[r.first_word : r.first_word + r.n_words]
        if not r.is_first:
            got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    for i, places in later.items():  # a leader may share less than another document: under 50 words stay at an end
        left = sorted(places - got.get(i, set()))
        assert all(b - a != 49 for a, b in zip(left, left[49:])), (i, left)
    assert shared <= {r.doc_id for r in rows}
    return later, got


def test_op3_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    later, got = check_against(docs, QUERIES["op3_substring_dedup"](spark, SF01).collect())
    # what is found beyond exact repeats is near: most of its shingles are in documents with smaller ids
    seen = {}
    for i, t in sorted(docs):
        w = words(t)
        own = [tuple(w[s : s + 5]) for s in range(len(w) - 4)]
        if i in got:
            inside = [g for s, g in enumerate(own) if set(range(s, s + 5)) <= got[i]]
            assert np.mean([seen.get(g, i) < i for g in inside]) > 0.8
        for g in own:
            seen.setdefault(g, i)


def made(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    new = lambda n: rng.choices(vocabulary, k=n)
    hot, line, long = new(55), new(20), new(400)
    docs = []
    for i in range(300):
        w = new(rng.randrange(0, 120))
        if i % 3 == 0:
            w += hot
        if i % 4 == 0:
            w += line
        if i % 10 == 0:
            at = rng.randrange(300)
            w = w + long[at : at + 60 + i % 40]
        if i % 50 == 7:
            w += ["spam", "ham"] * 100 + ["spam"] * 100
        docs.append((i, "  ".join(w + new(rng.randrange(0, 60))).upper().replace("  W1", " - w1")))
    near = new(120)
    docs += [(900, " ".join(near)), (901, " ".join(new(30) + near[:60] + ["changed"] + near[61:] + new(30))), (902, None), (903, ""), (904, "a b c"), (905, " ".join(hot) + "\x1c" + "\n".join(line))]
    docs += [(906, "word " * 30_000 + " ".join(hot))]
    return docs


def test_op3_made_passages(spark):
    docs = made(spark)
    df = spark.createDataFrame([*docs, (None, docs[0][1]), docs[0], docs[3]], "doc_id long, text string").withColumns({"key": F.lit("clash"), "source": F.lit(1), "place": F.lit(None).cast("int")})
    rows = substring_dedup.repeated_passages(df).collect()
    _, got = check_against(docs, rows)
    assert len(got[901]) >= 110 and {r.source for r in rows if r.doc_id == 901} == {900}
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0
    left = {r.doc_id: r for r in substring_dedup.cut(df, substring_dedup.repeated_passages(df)).collect() if r.doc_id is not None}
    assert left[902].text is None and left[903].text == "" and left[0].text == docs[0][1] and left[0].key == "clash"
    later, _ = exact_repeats([(i, r.text) for i, r in left.items()])
    assert not later
    w = words(dict(docs)[901])
    assert words(left[901].text) == [x for k, x in enumerate(w) if k not in got[901]]


def test_op3_leading_white_space(spark):
    rng = random.Random(8)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    start, end = new(60), new(60)
    docs = [(0, " " + " ".join(start + new(20))), (1, "\n\n \t" + " ".join(start + new(30))), (2, "  " + " ".join(new(30) + end)), (3, "\u3000\r\n" + "\n".join(new(9) + end)), (4, " \n" + " ".join(end))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    passages = substring_dedup.repeated_passages(df)
    rows = passages.collect()
    later, got = check_against(docs, rows)
    assert got == later and set(later) == {1, 3, 4}
    left = {r.doc_id: words(r.text) for r in substring_dedup.cut(df, passages).collect()}
    assert left == {i: [w for k, w in enumerate(words(t)) if k not in later.get(i, ())] for i, t in docs if i != 4}


def test_op3_leaders_that_hold_less(spark):
    rng = random.Random(9)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for k in range(40):  # the leader quotes a part first and holds the whole passage later
        whole = new(55)
        docs += [(10 * k, " ".join(new(5) + whole[:49] + new(20) + whole + new(5))), (10 * k + 1, " ".join(new(7) + whole + new(9)))]
    for k in range(40, 80):  # the leader holds too little of what two later documents share; one of these matches it
        lead, rest = new(60), new(10)
        docs += [(10 * k, " ".join(lead + new(9))), (10 * k + 1, " ".join(lead + rest)), (10 * k + 2, " ".join(new(9) + lead[-45:] + rest + new(9)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    passages = substring_dedup.repeated_passages(df)
    later, got = check_against(docs, passages.collect())
    assert len(later) == 120 and all(later[i] <= got[i] for i in later)
    assert not exact_repeats([(r.doc_id, r.text) for r in substring_dedup.cut(df, passages).collect()])[0]


def shingle_similarity(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def changed(rng, passage, kinds, low, high):
    """A copy of 50 words and more with a similarity to the passage in [low, high]."""
    while True:
        out = list(passage)
        for _ in range(rng.randrange(1, 2 + len(out) // 20)):
            at, kind = rng.randrange(len(out)), rng.choice(kinds)
            out[at : at + (kind != "insert")] = [] if kind == "delete" else [f"new{rng.randrange(10**6)}"]
        if low <= shingle_similarity(passage, out) <= high and len(out) >= 50:
            return out


def near_documents(rng, case):
    """Documents and, for each copy (doc_id), the words of its passage."""
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    docs, copies, line = [], {}, new(20)
    for k in range(60):
        passage = new(rng.randrange(55, 150))
        if case == "common line":
            passage[10:30] = line
        kinds = [case] if case in ("replace", "insert", "delete") else ["replace", "insert", "delete"]
        if case == "third leader":  # the first document is not near to the last, the second is
            lead = passage
            passage = changed(rng, lead, kinds, 0.55, 0.75)
            copy = next(c for _ in iter(int, 1) if shingle_similarity(lead, c := changed(rng, passage, kinds, 0.8, 1)) < 0.75)
            docs.append((10 * k, new(20) + lead + new(9)))
        else:
            copy = changed(rng, passage, kinds, 0.8, 1)
        docs += [(10 * k + 1, new(rng.randrange(60)) + passage + new(rng.randrange(60))), (10 * k + 2, new(rng.randrange(60)) + copy + new(rng.randrange(60)))]
        copies[10 * k + 2] = copy
    if case == "common line":
        docs += [(10_000 + k, new(40) + line + new(40)) for k in range(200)] + [(-k - 1, new(40) + line + new(40)) for k in range(5)]
    return docs, copies


@pytest.mark.parametrize("case", ["replace", "insert", "delete", "mixed", "third leader", "common line"])
def test_op3_recall_of_near_repeats(spark, case):
    docs, copies = near_documents(random.Random(11), case)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    text = {i: w for i, w in docs}
    got = {}
    for r in substring_dedup.repeated_passages(df).filter("not is_first").collect():
        got.setdefault(r.doc_id, []).extend(text[r.doc_id][r.first_word : r.first_word + r.n_words])
    found = [i for i, copy in copies.items() if len(set(copy) & set(got.get(i, []))) >= 0.8 * len(set(copy))]
    assert len(found) >= 0.9 * len(copies), len(found)
    for i, w in got.items():  # nothing but a passage, up to a few words at its ends
        assert case == "third leader" or (i in copies and len(set(w) - set(copies[i])) <= 8)


def test_op3_target_among_many_variants(spark):
    """A copy of one of 24 variants of a passage that is near to no other variant: neither the first nor the last before it."""
    rng, docs, copies = random.Random(24), [], {}
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    kinds = ["replace", "insert", "delete"]
    for g in range(40):
        lead = new(rng.randrange(80, 150))
        own = [changed(rng, lead, kinds, 0.55, 0.75) for _ in range(24)]
        while True:
            k = rng.randrange(24)
            copy = changed(rng, own[k], kinds, 0.82, 1)
            if all(shingle_similarity(copy, o) < 0.75 for i, o in enumerate(own) if i != k):
                break
        docs += [(1000 * g + i, new(rng.randrange(40)) + o + new(rng.randrange(40))) for i, o in enumerate(own)]
        copies[1000 * g + 999] = copy
        docs.append((1000 * g + 999, new(rng.randrange(40)) + copy + new(rng.randrange(40))))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    text, got = dict(docs), {}
    for r in substring_dedup.repeated_passages(df).filter("not is_first").collect():
        got.setdefault(r.doc_id, []).extend(text[r.doc_id][r.first_word : r.first_word + r.n_words])
    found = [i for i, copy in copies.items() if len(set(copy) & set(got.get(i, []))) >= 0.8 * len(set(copy))]
    assert len(found) >= 0.9 * len(copies), len(found)


def test_match_costs_its_texts_not_each_shared_place():
    """Two texts that share every second shingle: 20,000 shared places, none of which has a passage around it."""
    n = 40_000
    a, b = np.arange(n, dtype=np.uint64), np.arange(n, dtype=np.uint64)
    b[1::2] += np.uint64(n)
    places = np.arange(0, n, 2)
    before = time.perf_counter()
    assert substring_dedup.match(a, b, places, places, 100, 46, 0.8) == []
    assert time.perf_counter() - before < 1.5
    b[101:300] = a[101:300]
    assert any(s <= 100 and e >= 300 for s, e, *_ in substring_dedup.match(a, b, places, places, 100, 46, 0.8))


def test_rows_that_share_both_runs_meet_once(spark):
    crowd = [(1, 5, 70, False, None), (1, 9, 71, True, None), (2, 5, 70, False, 1), (2, 9, 71, True, 1), (2, 4, 72, False, 3), (2, 3, 73, False, None)]
    met = substring_dedup.all_meetings(spark.createDataFrame(crowd, "run long, doc_id long, at long, late boolean, twin long"))
    assert sorted(map(tuple, met.collect())) == [(9, 71, 3, 73), (9, 71, 4, 72), (9, 71, 5, 70)]


def test_scan_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        rows = sorted((rng.randrange(3), rng.randrange(200), rng.randrange(30), rng.randrange(30), rng.choice([0, 5, 5, 60]), rng.randrange(30), rng.randrange(30), rng.randrange(4)) for _ in range(rng.randrange(1, 25)))
        pair, c, back, ahead, apart, of_back, of_ahead, f = (np.array(x, np.int64) for x in zip(*rows))
        at = np.array([substring_dedup.pack(*x) for x in zip(c, back, ahead, f)])
        of = np.array([substring_dedup.pack(*x) for x in zip(c + apart, of_back, of_ahead, f)])
        got = {tuple(int(v) for v in x[:3]) + (int(x[3]) > 20,) for x in zip(*substring_dedup.scan(pair, at, of, 20))}
        want = set()
        for p in set(pair.tolist()):
            for far in (False, True):
                depth = {}
                for k in range(len(pair)):
                    if pair[k] == p and (apart[k] > 20) == far:
                        for x in range(c[k] - min(back[k], of_back[k]), c[k] + min(ahead[k], of_ahead[k]) + 1):
                            depth.setdefault(x, set()).add(int(f[k]))
                runs, last = [], None
                for x in sorted(x for x, s in depth.items() if len(s) >= substring_dedup.ENOUGH):
                    runs[-1:] = [(runs[-1][0], x + 1)] if last == x - 1 else [*runs[-1:], (x, x + 1)]
                    last = x
                want |= {(p, a, b, far) for a, b in runs if b - a >= 20}
        assert got == want


def test_op3_hot_slots_and_long_texts(spark, monkeypatch):
    """Slots dealt to many, segments cut and requests in parts: the same rows."""
    rng = random.Random(12)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    hot, long = new(70), new(900)
    docs = [(k, " ".join(new(rng.randrange(30)) + hot + new(rng.randrange(30)))) for k in range(300)] + [(400, " ".join(long + hot)), (401, " ".join(new(300) + long)), (402, " ".join(long[:333]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = sorted((r.doc_id, r.first_word, r.n_words, r.char_start, r.char_end, r.is_first) for r in substring_dedup.repeated_passages(df).collect())
    assert {r[0] for r in plain if not r[5]} == {*range(1, 300), 400, 401, 402} and (401, 300, 900) in {r[:3] for r in plain}
    for name, value in (("SEGMENT_WORDS", 64), ("PARTS", 2), ("SPREAD", 8), ("HOT_SHARE", 1e-4)):
        monkeypatch.setattr(substring_dedup, name, value)
    dealt = sorted((r.doc_id, r.first_word, r.n_words, r.char_start, r.char_end, r.is_first) for r in substring_dedup.repeated_passages(df).collect())
    assert [r for r in dealt if not r[5]] == [r for r in plain if not r[5]]


def test_op3_repeated_words_meet_where_they_turn(spark):
    """Texts that share nothing but 30 times one word: their rows inside of it don't meet each other."""
    docs = [(k, " ".join([f"x{k}"] * 25 + ["the"] * 30 + [f"y{k}"] * 25)) for k in range(150)]
    docs += [(200 + k, " ".join([f"x{k}"] * 9 + ["a"] * 20 + ["b"] * (20 + k) + ["c"] * 20 + [f"y{k}"] * 9)) for k in range(3)]
    base = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, first_word long, end_word long, exact long")
    crowd = substring_dedup.crowds(substring_dedup.shared_windows(base, 5, 46), none, 5, 46)
    assert crowd.count() > 0 and substring_dedup.all_meetings(crowd).filter("doc_id < 200").count() == 0
    rows = substring_dedup.repeated_passages(base).filter("not is_first").collect()
    assert {r.doc_id for r in rows} == {201, 202} and all(r.n_words >= 60 for r in rows)


def test_likeliest_regions_come_first(spark):
    found = spark.createDataFrame([(1, 9, 5, 10, [0, 4]), (2, 9, 6, 12, [2, 8, 9]), (3, 8, 5, 0, [1])], "region long, doc_id long, source long, start long, place array<long>")
    assert sorted(r.region for r in substring_dedup.likeliest(found).collect()) == [1, 2, 3]
    assert sorted(r.region for r in substring_dedup.likeliest(found.filter("region < 3").withColumn("start", found.start * 0 + 10)).collect()) == [1, 2]
    same = spark.createDataFrame([(1, 9, 5, 10, [2, 4]), (2, 9, 6, 12, [0, 2, 9])], "region long, doc_id long, source long, start long, place array<long>")
    assert [r.region for r in substring_dedup.likeliest(same).collect()] == [2]


def near_families(rng, members, n=120):
    """Texts of which any two differ in one of ten words: they share many runs, and hardly any is near to another one."""
    lead = [f"v{rng.randrange(10**6)}" for _ in range(n)]
    return [(i, [w if rng.random() > 0.07 else f"new{rng.randrange(10**6)}" for w in lead]) for i in range(members)]


def test_rows_of_a_run_are_judged_before_they_make_regions(spark):
    docs = near_families(random.Random(31), 150)
    base = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").cache()
    none = spark.createDataFrame([], "doc_id long, first_word long, end_word long, exact long")
    crowd = substring_dedup.crowds(substring_dedup.shared_windows(base, 5, 46), none, 5, 46).cache()
    met = substring_dedup.near_sources(substring_dedup.with_surroundings(base, substring_dedup.cells(crowd), 5), 46, 0.8).cache()
    pairs = substring_dedup.each_source(met, 1, 1 << 30).count()
    assert 0 < met.count() <= pairs and 4 * pairs < substring_dedup.all_meetings(crowd).count()
    # what is kept lies around a passage of both texts
    near = substring_dedup.compared(base, substring_dedup.regions(substring_dedup.each_source(met), 5, 46, 1), 5, 46, 0.8)
    sources = {(r.doc_id, r.source) for r in substring_dedup.each_source(met).collect()}
    found = {(r.doc_id, r.source) for r in near.collect()}
    assert found <= sources and len(found) >= 0.9 * len(sources)


def test_rows_of_a_run_are_dealt_to_cells(spark, monkeypatch):
    crowd = spark.createDataFrame([(1, d, 70 + d, d % 3 == 0, None) for d in range(40)] + [(2, 5, 1, False, None)], "run long, doc_id long, at long, late boolean, twin long")
    whole = sorted(map(tuple, substring_dedup.all_meetings(crowd).collect()))
    assert whole == sorted((d, 70 + d, s, 70 + s) for d in range(0, 40, 3) for s in range(d))
    monkeypatch.setattr(substring_dedup, "BLOCK", 9)
    dealt = substring_dedup.cells(crowd)
    assert dealt.groupBy("run", "a", "b").count().count() > 9
    assert sorted(map(tuple, substring_dedup.all_meetings(crowd).collect())) == whole


def test_near_stretches():
    at, least = substring_dedup.AROUND + substring_dedup.SLIP, 46
    text = np.arange(1, 2 * at + 2, dtype=np.uint16)
    other = lambda *gone: np.where(np.isin(np.arange(len(text)), gone), text + 1000, text).astype(np.uint16)
    judge = lambda b: tuple(int(x[0]) for x in substring_dedup.near_stretches(text[None], b[None], least, 0.8)[:3])
    assert judge(other()) == (1, -60, 61)
    assert judge(other(*range(at + 9, at + 14), *range(0, at - 39), *range(at + 30, 2 * at + 1))) == (1, -39, 9)
    assert judge(other(*range(at + 20, 2 * at + 1), *range(0, at - 20)))[0] == 0
    assert judge(other(*range(at + 30, 2 * at + 1)))[0] == 1
    moved = np.concatenate([text[3 : at + 5], [2000, 2001, 2002], text[at + 5 :]]).astype(np.uint16)  # three words more before the place
    moved = np.concatenate([moved, np.zeros(len(text) - len(moved), np.uint16)])
    assert moved[at - 3] == text[at] and judge(np.roll(moved, 3))[0] == 1
