"""Normalised policy, gradients of every objective (G2) and online training with a changing policy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefengine.operators import fit as G
from prefengine.operators import online as N
from prefengine.operators import policy as Y
from prefengine.operators.objectives import objective
from prefengine.session import shared_dir

DIM = 3
SETS = "prompt int, cand int, phi array<double>, score double, has_eos boolean"


def sets(spark, n=12, seed=0, size=5):
    rng = np.random.default_rng(seed)
    rows = [(p, c, rng.normal(size=DIM).tolist(), float(rng.integers(0, 4)), bool(rng.random() < 0.8)) for p in range(n) for c in range(2 + p % size)]
    return spark.createDataFrame(rows, SETS), rows


def softmax(phi, theta):
    s = np.array(phi) @ np.array(theta)
    z = s.max() + np.log(np.exp(s - s.max()).sum())
    return s - z, z


def test_set_softmax_is_stable_for_any_size_and_score(spark):
    rng = np.random.default_rng(1)
    by = {0: rng.normal(size=(400, 2)), 1: rng.normal(size=(1, 2)), 2: np.array([[1e4, 0.0], [1e4, 1.0], [-1e4, 0.0]]),
          3: np.array([[-2e4, 0.0], [-2e4 - 1, 3.0]]), 4: np.array([[255.9, 1.0], [256.1, 2.0]]), 5: np.array([[1.0, 7.0]] * 9)}
    rows = [(k, [float(x) for x in v]) for k, m in by.items() for v in m]
    df = spark.createDataFrame(rows, "p int, phi array<double>").repartition(6)
    theta = [1.0, 0.5]
    got = {r["p"]: r for r in Y.set_softmax(df, ["p"], theta, mean=True).collect()}
    assert got.keys() == by.keys()
    for k, m in by.items():
        logp, z = softmax(m, theta)
        assert got[k]["log_z"] == pytest.approx(z, rel=1e-12)
        assert got[k]["mean_phi"] == pytest.approx((np.exp(logp)[:, None] * m).sum(0).tolist(), rel=1e-9, abs=1e-9)
    plain = Y.set_softmax(df, ["p"], theta)
    assert plain.columns == ["p", "log_z"]
    assert {r["p"]: r["log_z"] for r in plain.collect()} == {k: pytest.approx(r["log_z"]) for k, r in got.items()}
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Join" not in plan and "Window" not in plan  # a hot set leaves each task as one row


def test_candidate_logps_sum_to_one(spark):
    df, _ = sets(spark)
    total = Y.candidate_logps(df, ["prompt"], [0.3, -1.0, 2.0]).groupBy("prompt").agg(F.sum(F.exp("logp")).alias("t")).collect()
    assert len(total) == 12 and all(r["t"] == pytest.approx(1.0) for r in total)


@pytest.mark.parametrize("kind,base", [("dpo", "ipo"), ("ipo", "ipo"), ("is", "ipo"), ("is", "sigmoid"), ("rpo", "ipo"), ("length", "ipo"),
                                       ("reward", "ipo"), ("sft", "ipo")])
def test_gradient_is_the_difference_quotient_of_the_objective(spark, kind, base):
    cands, rows = sets(spark, n=8, seed=2)
    rng = np.random.default_rng(3)
    pairs = []
    for p in range(8):
        own = [r for r in rows if r[0] == p]
        pairs.append((p, own[0][2], own[1][2], *[float(x) for x in rng.normal(size=4) - 1], int(rng.integers(1, 40)), int(rng.integers(1, 40))))
    df = spark.createDataFrame(pairs, "prompt int, chosen_phi array<double>, rejected_phi array<double>, ref_chosen_logps double, ref_rejected_logps double, "
                                      "data_chosen_logps double, data_rejected_logps double, chosen_length int, rejected_length int").cache()
    theta, par = [0.4, -0.7, 1.1], dict(beta=0.3, eps=0.25, eta=0.2, alpha=0.01, base=base)

    def scored(t):
        out = Y.pair_logps(df, cands, ["prompt"], t, mean=True)
        return out.withColumns({"logp": F.col("chosen_logps"), "chosen_score": Y.dot(F.col("chosen_phi"), t), "rejected_score": Y.dot(F.col("rejected_phi"), t)})

    got = {r["dim"]: r["grad"] for r in G.preference_gradient(
        scored(theta), theta, kind, ref_chosen="ref_chosen_logps", ref_rejected="ref_rejected_logps", data_chosen="data_chosen_logps",
        data_rejected="data_rejected_logps", logps=("chosen_logps", "rejected_logps"), **par).collect()}
    weights = {r["prompt"]: r["weight"] for r in objective(scored(theta), kind, **par).collect()}
    step = 1e-5
    for i in range(DIM):
        loss = []
        for sign in (1, -1):
            t = [x + sign * step * (j == i) for j, x in enumerate(theta)]
            out = objective(scored(t), kind, **par).collect()
            # the weight is held constant
            loss.append(np.mean([r["loss"] / (r["weight"] if kind == "is" else 1) * (weights[r["prompt"]] if kind == "is" else 1) for r in out]))
        assert got[i] == pytest.approx((loss[0] - loss[1]) / (2 * step), rel=1e-5, abs=1e-8)


def test_fit_every_kind_lowers_the_loss(spark):
    cands, rows = sets(spark, n=20, seed=5)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    pairs = [(p, max(own, key=lambda r: r[2][0])[2], min(own, key=lambda r: r[2][0])[2]) for p, own in by.items()]
    df = spark.createDataFrame(pairs, "prompt int, chosen_phi array<double>, rejected_phi array<double>")
    for kind in ("rpo", "sft"):
        theta = G.fit_preference(df, DIM, steps=3, lr=1.0, kind=kind, beta=1.0, cands=cands, key=["prompt"])
        assert theta[0] > 0.3
    with pytest.raises(ValueError):
        G.fit_preference(df, DIM, steps=1, kind="sft")  # no sets, no expectation
    with pytest.raises(ValueError):
        G.preference_gradient(df, [0.0] * DIM, "none")


def test_samples_follow_the_policy(spark):
    phi = [[0.0], [1.0], [2.0]]
    df = spark.range(4000).select(F.col("id").alias("p"), F.explode(F.array(*[F.struct(F.lit(i).alias("cand"), F.array(F.lit(v[0])).alias("phi")) for i, v in enumerate(phi)])).alias("c")) \
        .select("p", "c.cand", "c.phi")
    two = Y.sample_sets(df, ["p"], "cand", [0.7], ["phi"], 2, temperature=0.5, seed=9, round_=1)
    rows = two.collect()
    want = np.exp(np.array([0, 1.4, 2.8])) / np.exp(np.array([0, 1.4, 2.8])).sum()
    for k in (0, 1):
        share = np.bincount([r[f"cand_{k}"] for r in rows], minlength=3) / 4000
        assert np.abs(share - want).max() < 0.025 and all(r[f"phi_{k}"] == phi[r[f"cand_{k}"]] for r in rows)
    both = np.mean([r["cand_0"] == r["cand_1"] for r in rows])
    assert abs(both - (want ** 2).sum()) < 0.03  # independent draws
    assert sorted(two.collect()) == sorted(rows)
    other = Y.sample_sets(df, ["p"], "cand", [0.7], ["phi"], 2, temperature=0.5, seed=9, round_=2).collect()
    assert sorted(other) != sorted(rows)


RUN = N.Training(3, 2, epochs=2, beta=0.5, lr=1.0, warmup=1, seed=4, eval_every=5)


def log_of(df):
    return sorted(df.collect(), key=lambda r: r["update"])


def test_online_training_resumes_to_the_same_result(spark):
    cands, _ = sets(spark, n=14, seed=6)
    args = (cands, "prompt", "cand", [0.0] * DIM, RUN)
    whole = log_of(N.train_online(*args, shared_dir(spark, "t-online")))
    assert [r["update"] for r in whole] == list(range(6)) and sum(r["examples"] for r in whole) == 28
    assert [r["example_counter"] for r in whole] == [6, 12, 14, 20, 26, 28]
    assert [r["checkpoint"] for r in whole] == [True, True, False, True, True, False]
    assert whole[0]["lr"] == 0.0 and whole[1]["lr"] == 1.0 and whole[0]["theta"] == [0.0] * DIM  # warm-up of one update
    assert len({tuple(r["theta"]) for r in whole}) == 6
    path = shared_dir(spark, "t-online-part")
    part = log_of(N.train_online(*args, path, max_updates=2))  # ended after two updates
    assert part == whole[:2]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    half = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log/update=2/_temporary/part")  # and in the middle of the third
    fs.create(half).close()
    assert log_of(N.train_online(*args, path)) == whole
    assert log_of(N.train_online(*args, path)) == whole  # nothing left to do
    torn = shared_dir(spark, "t-online-torn")  # ended while the prompts were dealt
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{torn}/sets/update=0/part-0.parquet")).close()
    assert log_of(N.train_online(*args, torn)) == whole


def test_online_training_prefers_what_the_judge_prefers(spark):
    cands, _ = sets(spark, n=40, seed=7)
    judged = cands.withColumn("score", F.get("phi", F.lit(0))).withColumn("has_eos", F.lit(True))
    for kind in ("dpo", "ipo", "rpo", "sft"):
        run = N.Training(20, 1, epochs=3, kind=kind, beta=0.5, lr=0.5, seed=1)
        log = log_of(N.train_online(judged, "prompt", "cand", [0.0] * DIM, run, shared_dir(spark, "t-judge")))
        assert len(log) == 6 and log[-1]["theta"][0] > 0.2, kind
        assert log[0]["kl"] == pytest.approx(0.0) and log[0]["accuracy"] == 0.0
    unscored = cands.withColumn("score", F.lit(None).cast("double")).withColumn("has_eos", F.lit(True))
    with pytest.raises(Exception, match="no score"):
        N.train_online(unscored, "prompt", "cand", [0.0] * DIM, RUN, shared_dir(spark, "t-null"))
    assert N.train_online(cands.limit(0), "prompt", "cand", [0.0] * DIM, RUN, shared_dir(spark, "t-empty")).count() == 0
