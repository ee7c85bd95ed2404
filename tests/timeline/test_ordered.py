"""The overlap of two logs against comparing every length."""

import random

import numpy as np
import pytest

from tidemark.operators import ordered

SCHEMA = "seq long, a long, b string"


def plain(old, new):
    return next((k for k in range(min(len(old), len(new)), 0, -1) if old[-k:] == new[:k]), 0)


def logs(rng):
    row = lambda: (rng.choice([1, 1, 1, 2, None]), rng.choice(["x", "x", None]))
    old = [row() for _ in range(rng.choice([1, 5, 40]))]
    kind = rng.randrange(5)
    if kind == 0:
        return old, old[len(old) // 2 :] + [row() for _ in range(6)]
    if kind == 1:
        return [(1, "x")] * 30, [(1, "x")] * rng.choice([3, 30, 50])
    if kind == 2:
        return old, [row() for _ in range(20)]
    if kind == 3:
        return [(1, "x"), (2, "x")] * 10, [(1, "x"), (2, "x")] * 4 + [(1, None)]
    return old, old


@pytest.mark.parametrize("seed", range(7))
def test_against_every_length(spark, seed):
    old, new = logs(random.Random(seed))
    table = lambda rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], SCHEMA).repartition(3)
    want = plain(old, new)
    assert ordered.overlap(table(old), table(new), block=7) == want
    if seed < 3:
        got = sorted(ordered.append_ordered(table(old), table(new), block=7).collect())
        assert [tuple(r) for r in got] == [(k, *r) for k, r in enumerate(new[want:], len(old) + 1)]


def test_empty_logs(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, "x")], SCHEMA)
    assert ordered.overlap(none, some) == ordered.overlap(some, none) == 0
    assert [tuple(r) for r in ordered.append_ordered(none, some).collect()] == [(1, 1, "x")]


def test_a_false_candidate_is_checked(spark, monkeypatch):
    monkeypatch.setattr(ordered, "candidates", lambda m, i, c, s, n, b: m.sparkSession.createDataFrame([(3,), (2,), (1,)], "k long"))
    table = lambda rows: spark.createDataFrame([(k, r, None) for k, r in enumerate(rows, 1)], SCHEMA)
    assert ordered.overlap(table([1, 2, 3]), table([2, 3, 4])) == 2


def test_powers():
    assert ordered._power_of(np.arange(70, dtype=np.uint64)).tolist() == ordered._powers(0, 70).tolist() == [pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(70)]
