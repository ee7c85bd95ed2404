"""Whitening against whole-number arithmetic in plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / 5).astype(np.float32)


@pytest.mark.parametrize(("n", "d"), [(300, 12), (40, 3), (65, 9)])
def test_against_numpy(spark, n, d):
    rows = vectors(n, d)
    table = [(k, [float(c) for c in v], 7) for k, v in enumerate(rows)] + [(-1, None, 1), (-2, [0.5] * (d - 1) + [None], 1), (-3, [float("nan")] * d, 1), (-4, [float("inf")] + [0.0] * (d - 1), 1), (-5, [1.0], 1)]
    got = whitening.whiten(spark.createDataFrame(table, "vec_id long, embedding array<float>, n int").repartition(4)).collect()
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in rows])
    sums = x.sum(axis=0)
    covariance = np.array([[float(Fraction(int(n * (x[:, a] * x[:, b]).sum() - sums[a] * sums[b]), n * n)) for b in range(d)] for a in range(d)])
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components[:, ::-1]
    k = min(8, d)
    want = (x - sums / n) @ components[:, :k] / np.sqrt(values[:k])
    assert len(got) == n * k and {r.n for r in got} == {n}
    for r in got:
        assert r.deviation == sum(int(c) ** 2 for c in n * x[r.vec_id] - sums)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    for c in range(k):
        column = np.array([r.whitened for r in sorted(got) if r.component == c + 1])
        assert np.allclose(column, want[:, c], atol=1e-8) or np.allclose(column, -want[:, c], atol=1e-8)


def test_scatter_is_exact():
    rng = random.Random(4)
    for largest in (1, 3, 1000, 1 << 40, (1 << 61) - 1):
        rows = np.array([[rng.randint(-largest, largest) for _ in range(4)] for _ in range(130)])
        least, most = rows.min(axis=0).tolist(), rows.max(axis=0).tolist()
        sums = whitening.Scatter(least, most)
        sums.add(rows[:70])
        sums.add(rows[70:])
        got = {(a, b): total for a, b, total in sums.totals()}
        assert got == {(a, b): sum((int(p) - least[a]) * (int(q) - least[b]) for p, q in zip(rows[:, a], rows[:, b], strict=True)) for a in range(4) for b in range(a, 4)}


def test_digits():
    for value in (0, 1, -1, 1 << 62, -(1 << 100) + 12345, (1 << 130) - 7):
        assert whitening._whole(tuple(whitening._digits(value))) == value


def test_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 5, [(1, [])]):
        found = whitening.whiten(make(rows))
        assert found.columns == columns and found.count() == 0
    # a constant and a doubled dimension give one component less each
    rows = [(k % 3, [k / 7, 2.0, (k * k) % 5 / 3]) for k in range(20)]
    got = whitening.whiten(make(rows)).collect()
    assert {r.component for r in got} == {1, 2} and len(got) == 40
    # entries too large for a long are cut, and sums stay exact
    got = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r.vec_id: r.deviation is None for r in got} == {1: True, 2: True, 3: False} and all(math.isfinite(r.whitened) for r in got)
