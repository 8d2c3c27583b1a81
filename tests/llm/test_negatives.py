import math

import numpy as np
import pytest

from prefengine.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, x int, length double, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "u", 1, 2.0, "b") for i, label, v in rows], SCHEMA)


def brute(rows, every=100, positives=5, k=10):
    """All pairs in plain integers; rows are (id, label, vector)."""
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(c)) for c in v]) for i, label, v in rows]
    out = []
    for a, (i, label, x) in enumerate(rows):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j, other) for b, (j, other, y) in enumerate(rows) if b != a)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [(-t, m) for t, m, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:k]
            out += [(i, j, rank, m, -s, t) for rank, (t, m) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    got = negatives.mine(table(spark, rows).repartition(3), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 9))
    rows = [(int(i), int(i % 5 if i % 3 else 1), [float(c) for c in (centres[i % 4] + rng.normal(size=9) * 0.7) * rng.choice([0.2, 1, 3])]) for i in range(900)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(120)]  # a very common vector
    rows += [(2000 + i, 3, [0.0] * 9) for i in range(30)] + [(300, 2, rows[5][2]), (300, 2, rows[5][2]), (-100, 0, rows[8][2])]
    odd = [(3000, None, rows[1][2]), (None, 1, rows[1][2]), (3100, 1, None), (3200, 1, [float("nan")] * 9), (3300, 1, [float("inf")] * 9),
           (3400, 1, [None] * 9), (3500, 1, [1.0]), (3600, 1, []), (3700, 1, [1e30] * 9)]
    want = brute(rows)
    assert want and mined(spark, rows + odd) == want
    monkeypatch.setattr(negatives, "BUCKET", 64)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    assert mined(spark, rows + odd) == want
    assert mined(spark, rows, every=60, positives=2, negatives=3) == brute(rows, 60, 2, 3)


def test_ranges_hold_all_that_score():
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(500, 6)) * 100).astype(np.int64)
    x[:20] = 0
    lengths = np.sqrt((x.astype(float) ** 2).sum(1))
    uid = np.arange(500)
    bucket = negatives.Bucket(uid, uid, uid % 3, x, lengths)
    assert all((np.diff(row) >= 0).all() for row in bucket.lists)
    fewer = 0
    for a in (30, 200, 499):
        scores = x @ x[a]
        for least in (-5.0, 0.0, 1.0, scores.max() * 0.5, float(scores.max()), scores.max() * 1.01, lengths.max() * lengths[a] * 1.1):
            got = bucket.candidates(x[a] / lengths[a], lengths[a], least)
            if got is not None:
                assert set(np.flatnonzero(scores >= least)) <= set(got.tolist())
                fewer += len(got) < 250
    assert fewer >= 6
    assert len(bucket.candidates(np.zeros(6), 0.0, 1.0)) == 0 and bucket.candidates(np.zeros(6), 0.0, 0.0) is None


def test_large_scores_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i * 50, i % 2, [float(c) for c in rng.integers(10**6, 3 * 10**6, 3) + 0.37]) for i in range(40)]
    rows += [(5000 + i, i % 2, [v * 0.7 for v in rows[i][2]]) for i in range(40)]
    want = brute(rows)
    assert want and max(r[4] for r in want) > 1 << 53 and mined(spark, rows) == want


def test_nothing_to_mine(spark):
    one = [(100, 1, [1.0, 0.0])]
    for rows in ([], one, [(1, 1, [1.0, 0.0]), (2, 2, [0.5, 0.0])], [*one, (101, 1, [-1.0, 0.0]), (102, 2, [0.5, 0.0])], [(100, None, [1.0])]):
        assert mined(spark, rows) == []
    rows = [*one, (101, 1, [0.0, 1.0]), (102, 2, [0.0, 2.0]), (103, 2, [0.0, -1.0]), (104, 2, [1.0, 0.0])]
    assert mined(spark, rows) == brute(rows) == [(100, 101, 1, 102, 0, 0), (100, 101, 2, 103, 0, 0)]


def test_plan_deals_rows_by_cell(spark):
    rows = [(i, 1 if i % 3 else 2, [float(i % 7), 1.0]) for i in range(300)]
    plan = negatives.mine(table(spark, rows))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(Exception):
        negatives.mine(table(spark, rows), vector_col="none")
