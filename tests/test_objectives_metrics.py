"""J1-J7 properties and M1-M9."""

import math

import pytest
from pyspark.sql import functions as F

from prefengine.operators import metrics as M
from prefengine.operators.objectives import objective

COLS = "chosen_logps double, rejected_logps double, ref_chosen_logps double, ref_rejected_logps double"


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, COLS + extra)


def test_h_zero(spark):
    df = frame(spark, [(-1.0, -1.0, -2.0, -2.0)])
    assert objective(df, "dpo", beta=0.1).first()["loss"] == pytest.approx(math.log(2))
    assert objective(df, "ipo", beta=0.1).first()["loss"] == pytest.approx(25.0)


def test_extreme_h_finite(spark):
    df = frame(spark, [(1000.0, 0.0, 0.0, 0.0), (-1000.0, 0.0, 0.0, 0.0)])
    for kind in ("dpo", "ipo", "rpo"):
        for r in objective(df, kind, beta=1.0).collect():
            assert math.isfinite(r["loss"])


def test_is_weight(spark):
    rows = [(-1.0, -2.0, -1.5, -2.5, -1.0, -2.0), (-1.0, -2.0, -1.5, -2.5, -5.0, -5.0), (0.0, 0.0, 0.0, 0.0, 3.0, 3.0)]
    df = frame(spark, rows, ", data_chosen_logps double, data_rejected_logps double")
    out = objective(df, "is", beta=0.1, eps=0.25).collect()
    ipo = objective(df, "ipo", beta=0.1).collect()
    assert out[0]["weight"] == pytest.approx(1.0) and out[0]["loss"] == pytest.approx(ipo[0]["loss"])
    assert out[1]["weight"] == pytest.approx(math.exp(0.5))  # clipped at 2 eps
    assert all(r["weight"] <= math.exp(0.5) + 1e-12 for r in out)
    sig = objective(df, "is", beta=0.1, base="sigmoid").collect()
    dpo = objective(df, "dpo", beta=0.1).collect()
    assert sig[0]["loss"] == pytest.approx(dpo[0]["loss"])


def test_rpo_length_reduce_to_dpo(spark):
    df = frame(spark, [(-3.0, -5.0, -4.0, -4.5, 7, 3)], ", chosen_length int, rejected_length int")
    dpo = objective(df, "dpo", beta=0.1).first()["loss"]
    assert objective(df, "rpo", beta=0.1, eta=0.0).first()["loss"] == pytest.approx(dpo)
    assert objective(df, "length", beta=0.1, alpha=0.0).first()["loss"] == pytest.approx(dpo)
    assert objective(df, "length", beta=0.1, alpha=0.01).first()["loss"] != pytest.approx(dpo)


def test_reward_and_sft(spark):
    df = spark.createDataFrame([(2.0, 2.0, -3.0)], "chosen_score double, rejected_score double, logp double")
    assert objective(df, "reward").first()["loss"] == pytest.approx(math.log(2))
    assert objective(df, "sft").first()["loss"] == 3.0
    with pytest.raises(ValueError):
        objective(df, "dpo")


def test_pair_metrics(spark):
    df = frame(spark, [(-1.0, -3.0, -2.0, -2.0)])
    r = M.pair_metrics(df, 0.5).first()
    assert r["chosen_rewards"] == 0.5 and r["rejected_rewards"] == -0.5 and r["margins"] == 1.0 and r["accuracy"] == 1.0
    assert M.kl_estimate(df).first()["kl"] == pytest.approx(0.0)


def test_interval_means_partial(spark):
    df = spark.range(10).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))
    out = {r["interval"]: r for r in M.interval_means(df, ["v"], 2, 2, ["idx"]).collect()}
    assert out[0]["v"] == 1.5 and out[2]["examples"] == 2 and out[2]["v"] == 8.5


def test_running_accuracy(spark):
    df = spark.createDataFrame([(0, 1, True), (0, 2, False), (1, 1, False), (0, 3, True)], "run int, i int, hit boolean")
    out = {(r["run"], r["i"]): r["running_accuracy"] for r in M.running_accuracy(df, "hit", ["i"], by=["run"]).collect()}
    assert out[(0, 1)] == 1.0 and out[(0, 2)] == 0.5 and out[(0, 3)] == pytest.approx(2 / 3) and out[(1, 1)] == 0.0


def test_lr_schedule(spark):
    b = spark.range(8).select(F.col("id").alias("batch_id"))
    out = {r["batch_id"]: r["lr"] for r in M.with_lr(b, 64, 4, 2, 1, 1.0, 0).collect()}
    assert out[0] == pytest.approx(1.0)                   # warm-up 0: full lr at step 0
    assert out[7] == pytest.approx(0.5 * (1 + math.cos(math.pi * 3 / 8)) * 0.9 + 0.1)
    end = spark.range(1).select(M.cosine_lr(F.lit(8), 1.0, 0, 8)).first()[0]
    assert end == pytest.approx(0.1)
    zero = spark.range(1).select(M.cosine_lr(F.lit(0), 1.0, 2, 0)).first()[0]
    assert zero == 0.0


def test_checkpoint_steps(spark):
    b = spark.range(12).select(F.col("id").alias("batch_id"))
    got = sorted(r["example_counter"] for r in M.checkpoint_steps(b, 8, 20).collect())
    assert got == [40, 80]


def test_throughput(spark):
    df = spark.createDataFrame([(0, "2024-01-01 00:00:00"), (0, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:00")],
                               "g int, ts string").withColumn("ts", F.to_timestamp("ts"))
    out = {r["g"]: r["examples_per_second"] for r in M.throughput(df, "ts", ["g"]).collect()}
    assert out[0] == pytest.approx(0.2) and out[1] is None
