"""Whitening: exact parts against plain whole-number arithmetic, results against floating point, odd rows and degenerate tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from riskloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string"


def plain_polynomial(m):
    """det(t I - m) by Faddeev and Le Verrier, in fractions."""
    d, c, k = len(m), [Fraction(1)], [[Fraction(0)] * len(m) for _ in m]
    for step in range(1, d + 1):
        k = [[sum(m[i][r] * k[r][j] for r in range(d)) + (c[-1] * m[i][j]) for j in range(d)] for i in range(d)]
        c.append(-sum(k[i][i] for i in range(d)) / step)
    return [int(v) for v in reversed(c)]


def symmetric(rnd, d, size):
    x = [[rnd.randint(-size, size) for _ in range(d)] for _ in range(d + rnd.randint(-2, 3))]
    return [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


def test_polynomial_is_exact(spark):
    rnd = random.Random(1)
    for d, size in ((1, 5), (2, 9), (5, 1000), (7, 1 << 40), (9, 2)):
        m = symmetric(rnd, d, size)
        want = plain_polynomial(m)
        assert whitening.chinese({p: whitening.characteristic_mod(m, p) for p in whitening.primes_for(m)}) == want
    assert whitening.characteristic(spark, m) == want


def test_roots_are_isolated_and_counted():
    def poly(roots):
        c = [1]
        for r in roots:
            c = [(c[k - 1] if k else 0) - r * (c[k] if k < len(c) else 0) for k in range(len(c) + 1)]
        return c

    for roots in ([5], [0, 0, 3], [7, 7, 7], [1, 2, 3, 4, 5], [10**12, 10**12 + 1, 10**12 - 1], [4, 4, 9, 9, 0], [0, 0]):
        found = whitening.largest_roots(poly(roots), 4)
        want = sorted({r for r in roots if r}, reverse=True)
        got = [(round(Fraction(m, 1 << bits)), times) for m, bits, times in found]
        assert got == [(r, roots.count(r)) for r in want][: len(got)] and sum(t for _, t in got) >= min(4, sum(r > 0 for r in roots))
        for (m, bits, _), (r, _) in zip(found, got, strict=True):
            assert abs(Fraction(m, 1 << bits) - r) < Fraction(r, 1 << 250)
        assert all(whitening.roots_above(poly(roots), a, 0) == sum(r > a for r in roots) for a in (0, 3, 4, 10**12))


def test_primes_and_products():
    assert [p for p in range(200) if whitening.is_prime(p)] == [p for p in range(2, 200) if all(p % q for q in range(2, p))]
    rnd = np.random.default_rng(2)
    for top in (9, 1 << 20, 1 << 27, 1 << 62):
        x = rnd.integers(-top, top, (50, 3))
        want = x.astype(object).T @ x.astype(object)
        assert (whitening.products(x) == want).all() and all(sum(v << whitening.LIMB * k for k, v in enumerate(whitening._limbs(int(w)))) == w for w in want.ravel())


def check(rows, found, components=4):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    d = max(lengths, key=lambda n: (lengths.count(n), n))
    good = [(i, v) for i, v in good if len(v) == d]
    fit = sorted({tuple(v) for _, v in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(v.T @ v / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-9 * max(values.max(), 1e-9)).sum()))
    assert len(found) == k * len(good)
    want = sorted(((i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in good for c in range(k)), key=repr)
    assert sorted(((r.vec_id, r.component, r.n, r.deviation) for r in found), key=repr) == want
    assert all(r.identity_error < 1e-9 and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 * r.explained for r in found)
    return good, fit, np.array(sums) / n, values, vectors, k


def test_against_floating_point(spark):
    rnd = np.random.default_rng(3)
    spread = np.array([3.0, 2.0, 1.5, 1.0, 0.7, 0.5])
    rows = [(k, [float(np.float32(c)) for c in rnd.normal(size=6) * spread]) for k in range(300)]
    rows += [(500 + k, rows[5][1]) for k in range(400)]  # copies count once in the fit
    rows += [(1000, None), (1001, []), (1002, [None] * 6), (1003, [float("nan")] * 6), (1004, [1.0, 2.0]), (None, rows[7][1]), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    found = whitening.whiten(frame).collect()
    good, fit, mean, values, vectors, k = check(rows, found)
    by = {}
    for r in found:
        by.setdefault(r.component, []).append(r)
    for c in range(k):
        want = {i: (np.array(x) - mean) @ vectors[:, c] / values[c] ** 0.5 for i, x in good}
        sign = np.sign(sum(want[r.vec_id] * r.whitened for r in by[c + 1]))
        assert max(abs(want[r.vec_id] * sign - r.whitened) for r in by[c + 1]) < 1e-9


@pytest.mark.parametrize("vectors", [
    [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)],  # one eigenvalue, three times
    [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]],  # of rank one
    [[0.5], [0.75], [0.25]],
    [[0.0, float(k)] for k in range(9)],
])
def test_degenerate_tables(spark, vectors):
    rows = list(enumerate(vectors))
    found = whitening.whiten(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    check(rows, found)


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[]]])
def test_tables_without_components(spark, vectors):
    found = whitening.whiten(spark.createDataFrame([(k, v, 1, "x") for k, v in enumerate(vectors)], SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.collect() == []


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(1 << 30) + k, float(k * k)]) for k in range(6)]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    check(rows, whitening.whiten(frame).collect())
    far = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    found = whitening.whiten(far).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and {r.deviation for r in found if r.vec_id == 1} == {None}
