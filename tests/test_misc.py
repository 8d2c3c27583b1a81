"""Remaining operator paths: decode with specials, policy attach, grids, pads, readers."""

import pytest
from pyspark.sql import functions as F

from prefengine.functions import arrays as A
from prefengine.operators import evaluate as V
from prefengine.operators import logprob as L
from prefengine.operators import tokens as K
from prefengine.operators.objectives import objective


def test_decode_keeps_specials_when_asked(spark):
    df = spark.createDataFrame([(1, "a b")], "k int, text string")
    v = K.fit_vocab(df, "text", max_size=5)
    enc = K.encode(df, ["k"], "text", v, out="ids").withColumn("ids", F.concat(F.array(F.lit(K.BOS)), "ids"))
    assert K.decode(enc, ["k"], "ids", v, out="t", skip_special=False).first()["t"] == "<bos> a b"


def test_attach_policy_and_reference(spark):
    pairs = spark.createDataFrame([(1,)], "k int")
    pol = spark.createDataFrame([(1, -1.0, -2.0)], "k int, chosen_logps double, rejected_logps double")
    ref = spark.createDataFrame([(1, -1.5, -1.5)], "k int, chosen_logps double, rejected_logps double")
    r = L.attach_logps(pairs, ["k"], policy=pol, ref=ref).first()
    assert (r["chosen_logps"], r["rejected_logps"], r["ref_chosen_logps"], r["data_rejected_logps"]) == \
        (-1.0, -2.0, -1.5, -1.5)


def test_sweep_grid_and_coverage(spark):
    grid = V.sweep_grid(spark, {"beta": ["0.1", "0.5"], "seed": ["0", "1", "2"]}, steps=1)
    assert grid.count() == 12
    res = spark.createDataFrame([("0.1", "0", 0), ("0.1", "0", 0), ("0.5", "2", 1)], "beta string, seed string, step bigint")
    cov = {(r["beta"], r["seed"], r["step"]): r["status"] for r in
           V.sweep_coverage(res, grid, ["beta", "seed", "step"]).collect()}
    assert cov[("0.1", "0", 0)] == "duplicate" and cov[("0.5", "2", 1)] == "ok" and cov[("0.1", "1", 1)] == "missing"


def test_pads(spark):
    df = spark.createDataFrame([([1, 2],)], "a array<int>")
    r = df.select(A.pad_left("a", 4, 0).alias("l"), A.pad_right("a", 3, -100).alias("r"), A.pad_right("a", 1, 0).alias("s")).first()
    assert r["l"] == [0, 0, 1, 2] and r["r"] == [1, 2, -100] and r["s"] == [1, 2]


def test_objective_validation(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "chosen_logps double, rejected_logps double, "
                               "ref_chosen_logps double, ref_rejected_logps double, data_chosen_logps double, "
                               "data_rejected_logps double")
    with pytest.raises(ValueError):
        objective(df, "nope")
    with pytest.raises(ValueError):
        objective(df, "is", base="nope")


def test_win_rate_rollup(spark):
    cand = spark.createDataFrame([("r1", 0, 1, 3.0), ("r1", 0, 2, 1.0), ("r1", 1, 1, 2.0), ("r2", 0, 1, 2.0)],
                                 "run_key string, step int, prompt_id int, score double")
    base = spark.createDataFrame([(1, 2.0), (2, 2.0)], "prompt_id int, score double")
    out = {(r["run_key"], r["step"]): (r["wins"], r["ties"], r["losses"]) for r in
           V.win_rate(cand, base, ["prompt_id"], ["run_key", "step"]).collect()}
    assert out[("r1", 0)] == (1, 0, 1) and out[("r1", None)] == (1, 1, 1) and out[(None, None)] == (1, 2, 1)
    best = V.best_checkpoint(V.win_rate(cand, base, ["prompt_id"], ["run_key", "step"], rollup=False),
                             "run_key", "step", "win_rate").collect()
    assert {(r["run_key"], r["step"]) for r in best} == {("r1", 0), ("r2", 0)}
