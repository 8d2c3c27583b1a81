"""G1, G2, U1, U2."""

import numpy as np
import pytest

from prefengine.operators import fit as G
from prefengine.operators import udf as U


def _pairs(spark, n=200, d=4, seed=0):
    rng = np.random.default_rng(seed)
    w = np.array([1.0, -2.0, 0.5, 0.0])
    rows = []
    for _ in range(n):
        a, b = rng.normal(size=d), rng.normal(size=d)
        c, r = (a, b) if a @ w > b @ w else (b, a)
        rows.append((c.tolist(), r.tolist()))
    return spark.createDataFrame(rows, "chosen_phi array<double>, rejected_phi array<double>"), rows


def test_gradient_matches_numpy(spark):
    df, rows = _pairs(spark, 50)
    theta = [0.1, 0.2, -0.1, 0.0]
    got = {r["dim"]: r["grad"] for r in G.preference_gradient(df, theta, "dpo", 0.5).collect()}
    c = np.array([r[0] for r in rows]); r_ = np.array([r[1] for r in rows])
    h = (c - r_) @ np.array(theta)
    want = ((-0.5 / (1 + np.exp(0.5 * h)))[:, None] * (c - r_)).mean(axis=0)
    assert [got[i] for i in range(4)] == pytest.approx(want.tolist())
    gi = {r["dim"]: r["grad"] for r in G.preference_gradient(df, theta, "ipo", 0.5).collect()}
    want_i = ((2 * (h - 1.0))[:, None] * (c - r_)).mean(axis=0)
    assert [gi[i] for i in range(4)] == pytest.approx(want_i.tolist())


def test_fit_preference_and_reward(spark):
    df, _ = _pairs(spark, 200)
    theta = G.fit_preference(df, 4, steps=5, lr=1.0, kind="dpo", beta=1.0)
    assert theta[0] > 0 and theta[1] < 0
    model = G.fit_reward(df, reg=0.0, max_iter=50)
    w = model.coefficients.toArray()
    assert w[0] > 0 and w[1] < 0


def test_score_and_generate_plugins(spark):
    calls = {"n": 0}

    def make_scorer():
        calls["n"] += 1
        return lambda s: s.str.len().astype(float)
    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    assert [r["score"] for r in U.score_with(df, make_scorer, "t").collect()] == [2.0, 4.0]

    def make_sampler():
        return lambda s, n: s.map(lambda p: [p + str(i) for i in range(n)])
    assert U.generate_with(df, make_sampler, "t", 2).first()["completion"] == ["ab0", "ab1"]


def test_is_gradient_weight_constant(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], -0.5, -0.5)],
                               "chosen_phi array<double>, rejected_phi array<double>, dc double, dr double")
    theta = [0.2, 0.1]
    g = {r["dim"]: r["grad"] for r in G.preference_gradient(df, theta, "is", 0.5, eps=0.25,
                                                            data_chosen="dc", data_rejected="dr").collect()}
    h = 0.2 - 0.1
    w = np.exp(min(0.2 + 0.5 + 0.1 + 0.5, 0.5))
    assert g[0] == pytest.approx(w * 2 * (h - 1.0)) and g[1] == pytest.approx(-w * 2 * (h - 1.0))
