"""Whitening against plain numbers, and the eigenvectors against exact ones."""

import math
import random

import numpy as np
import pytest

from runsift.llm import whitening


def rows_of(vectors):
    out = []
    for key, v in vectors:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((key, [math.floor(64 * x) + 1_000_000 for x in v]))
    width = max((len(x) for _, x in out), default=0)
    return [(k, x + [1_000_000] * (width - len(x))) for k, x in out]


def check(spark, vectors, components=16):
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in vectors], "vec_id bigint, embedding array<float>, x int, component string")
    plain = [(k, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for k, v in vectors]
    rows = rows_of(plain)
    found = whitening.whiten(df, components=components)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = found.collect()
    fit = sorted({tuple(x) for _, x in rows})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    x = np.array(fit, np.longdouble)
    mean = np.array([np.longdouble(s) for s in sums]) / n if n else 0
    cov = ((x - mean).T @ (x - mean)) / n
    e, v = np.linalg.eigh(cov.astype(float))
    e, v = e[::-1], v[:, ::-1]
    rank = int((e[:components] > 1e-10 * e.sum()).sum())
    assert len(found) == rank * len(rows) and {r.component for r in found} == set(range(1, rank + 1))
    assert {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-9
    off = sorted((repr(k), sum((n * a - s) ** 2 for a, s in zip(w, sums))) for k, w in rows)
    for c in range(1, rank + 1):
        mine = [r for r in found if r.component == c]
        assert sorted((repr(r.vec_id), r.deviation) for r in mine) == off
        assert all(abs(r.explained - e[c - 1] / e.sum()) < 1e-9 for r in mine)
    # Vectors of equal eigenvalues may be any of their space: compare the whole of it.
    groups = np.split(np.arange(rank), np.flatnonzero(np.diff(e[:rank]) < -1e-6 * e.sum()) + 1)
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    for k, w in rows:
        d = np.array([float(a) for a in np.array(w, np.longdouble) - mean])
        mine = by_row[k, sum((n * a - s) ** 2 for a, s in zip(w, sums))]
        for g in groups:
            if g[-1] + 1 == rank and rank < len(e) and e[rank] > e[rank - 1] * (1 - 1e-6):
                continue  # the cut goes through equal eigenvalues
            want = ((d @ v[:, g]) ** 2 / e[g]).sum()
            assert sum(mine[c + 1] ** 2 for c in g) == pytest.approx(want, rel=1e-6, abs=1e-7)
    return found


def vectors(n, width, seed):
    dice = random.Random(seed)
    scale = [1 / (1 + k) for k in range(width)]
    return [(i, [dice.gauss(0, 1) * s for s in scale]) for i in range(n)]


def test_random_vectors(spark):
    check(spark, vectors(300, 24, 1))
    check(spark, vectors(200, 5, 2), components=3)


def test_copies_count_once_and_order_does_not_matter(spark):
    some = vectors(60, 8, 3)
    a = check(spark, some + [(100 + k, some[0][1]) for k in range(200)] + some[:2])
    b = check(spark, (some + [(100 + k, some[0][1]) for k in range(200)] + some[:2])[::-1])
    value = lambda rows: sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in rows)
    assert value(a) == value(b)


def test_vectors_that_take_no_part_and_shorter_ones(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, [None] * 3), (902, [nan, 1.0, 1.0]), (903, [1.0, inf, 1.0]), (None, [0.5, 1.0, -2.0]), (905, [1.0]), (906, []), (907, [0.5, 1.0, -2.0])]
    check(spark, vectors(40, 3, 4) + odd)


def test_no_spread(spark):
    def n(rows):
        return whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).count()

    assert n([]) == 0 and n([(1, [1.0, 2.0])]) == 0 and n([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == 0
    assert n([(1, None)]) == 0 and n([(1, []), (2, [])]) == 0
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.5]), (3, [3.0, 2.5])])  # rank 1


def test_equal_eigenvalues(spark):
    corners = [(k, [2.0 * (k >> b & 1) - 1 for b in range(5)]) for k in range(32)]
    check(spark, corners)


def exact_basis(n, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(n) - q.T @ q) / 2
    return q


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 33) / 7,
        np.r_[np.ones(4) * 3, 3 + 1e-9 * np.arange(1, 5), 7, 9],
        np.r_[np.ones(10), 1 + 1e-12 * np.arange(1, 7)],
        np.r_[np.linspace(100, 100.0001, 20), np.zeros(5)],
        1e9 * np.geomspace(1, 1e-12, 12),
        np.zeros(3),
    ],
)
def test_eigenvectors_to_more_than_double_precision(values):
    q = exact_basis(len(values), 7)
    a = q * values.astype(np.longdouble) @ q.T
    e, x = whitening.eigen((a + a.T) / 2)
    size = float(np.abs(values).max()) or 1
    assert np.abs(a @ x - x * e).max() < 1e-17 * size
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(e - np.sort(values)[::-1]).max() < 1e-16 * size


def test_deviations_beyond_doubles_are_exact():
    d = np.array([[3, -4], [1, 2]], np.int64)
    n = 3_000_000_000
    found = whitening._deviations(d, n, [n // 3, 7])
    assert found == [v if v < 1 << 63 else None for v in ((n * 3 - n // 3) ** 2 + (4 * n + 7) ** 2, (n - n // 3) ** 2 + (2 * n - 7) ** 2)]
    n = 1000
    assert list(whitening._deviations(d, n, [5, 7])) == [(3000 - 5) ** 2 + (4000 + 7) ** 2, (1000 - 5) ** 2 + (2000 - 7) ** 2]
