import math
from fractions import Fraction

import numpy as np
import pytest

from prefengine.llm import whitening
from tests.conftest import SF_SMOKE

SCHEMA = "vec_id long, embedding array<double>, n int, x string, component int, deviation int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def fits(rows):
    """Distinct integer vectors, exact sums and the covariance in exact arithmetic."""
    x = sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for _, v in rows})
    n, s = len(x), [sum(c) for c in zip(*x)]
    centred = [[Fraction(n * c - t, n) for c, t in zip(v, s)] for v in x]
    d = len(s)
    return n, s, np.array([[float(sum(y[i] * y[j] for y in centred) / n) for j in range(d)] for i in range(d)])


def held(got, rows, k=16):
    n, s, v = fits(rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1].T
    rank = int((values > 1e-9 * values[0]).sum())
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(got) == len(rows) * min(k, rank)
    sign = {}
    for i, vec in rows:
        x = [math.floor(64 * float(c)) + 1_000_000 for c in vec]
        mine = by[i, sum((n * c - t) ** 2 for c, t in zip(x, s))]
        assert sorted(mine) == list(range(1, min(k, rank) + 1))
        y = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)])
        for c, r in mine.items():
            want = y @ axes[c - 1] / math.sqrt(values[c - 1])
            if abs(want) > 1e-3:
                sign.setdefault(c, 1 if want * r.whitened > 0 else -1)
            assert r.n == n and r.whitened == pytest.approx(sign.get(c, 1) * want, rel=1e-6, abs=1e-6)
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    for d, n in ((1, 9), (7, 40), (12, 5), (33, 100)):
        y = rng.normal(size=(n, d)) * np.logspace(0, -4, d)
        v = y.T @ y
        a = whitening.pivoted_cholesky(v)
        assert a.shape == (d, min(d, n)) and np.allclose(a @ a.T, v, rtol=1e-12, atol=1e-14)
        pivots = [int(np.flatnonzero(np.abs(a[:, c]) > 0)[np.argmax([(a[p, c + 1:] == 0).all() for p in np.flatnonzero(np.abs(a[:, c]) > 0)])]) for c in range(a.shape[1])]
        assert len(set(pivots)) == len(pivots)  # triangular in this order
        values, u = whitening.jacobi(a)
        want = np.linalg.svd(y, compute_uv=False)[:len(values)] ** 2
        assert np.allclose(values, want, rtol=1e-10) and np.allclose(u @ u.T, np.eye(len(u)), atol=1e-10)
        assert np.allclose(u.T * values @ u, v, rtol=1e-9, atol=1e-12)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_equals_exact_covariance(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 20)) @ np.diag(np.linspace(3, 0.5, 20)) + 5
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)] + [(None, rows[3][1])]
    odd = [(2000, None), (2001, [float("nan")] + [0.0] * 19), (2002, [float("-inf")] + [0.0] * 19), (2003, [None] + [0.0] * 19), (2004, [1.0]), (2005, []), (2006, [1e300] * 20)]
    held(whitening.whiten(table(spark, rows + odd).repartition(5)).collect(), rows)


def test_few_and_dependent_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(a), 7.0, float(b)]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)) * 10)]
    held(whitening.whiten(table(spark, rows)).collect(), rows)  # rank 2 of 4
    few = [(i, [float(c) for c in rng.normal(size=30) * 5]) for i in range(4)]
    held(whitening.whiten(table(spark, few)).collect(), few)
    assert len(whitening.whiten(table(spark, few), components=2).collect()) == 8
    for none in ([], few[:1], [few[0]] * 3, [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, none)).collect() == []


def test_large_entries(spark):
    for scale in (1e15, 1e6):
        rows = [(i, [float(c) * scale, float(i * c)]) for i, c in enumerate((1, -3, 2, 8))]
        n, s, _ = fits(rows)
        want = {i: sum((n * (math.floor(64 * c) + 1_000_000) - t) ** 2 for c, t in zip(v, s)) for i, v in rows}
        got = whitening.whiten(table(spark, rows)).collect()
        assert len(got) == 8 and {r.vec_id: r.deviation for r in got} == {i: e if e < 1 << 63 else None for i, e in want.items()}


def test_embeddings(spark):
    df = spark.read.parquet(f"{SF_SMOKE}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(rows) and max(r.identity_error for r in got) < 1e-9
    held(got, rows)
