"""Exact order semantics without a global window."""

import pytest
from pyspark.sql import functions as F

from prefengine.functions.arrays import zip_checked
from prefengine.operators import order as O


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_index_matches_row_number(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("dup"))
    out = O.global_index(df, ["dup", "k"], name="idx").collect()
    got = sorted((r["dup"], r["k"], r["idx"]) for r in out)
    assert [g[2] for g in got] == list(range(1000))


def test_global_index_grouped_with_hot_group(spark):
    # one group holds most rows; positions restart per group
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5).alias("g"),
                                  F.col("id").alias("k"))
    out = O.global_index(df, ["k"], partition_by=["g"]).groupBy("g").agg(
        F.min("idx"), F.max("idx"), F.count("*"), F.countDistinct("idx")).collect()
    for r in out:
        assert r[1] == 0 and r[2] == r[3] - 1 and r[4] == r[3]


def test_no_single_partition_exchange(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    for out in (O.global_index(df, ["k"]), O.assign_batches(df, 7, ["k"]), O.shuffled_index(df, 1, "k")):
        assert "SinglePartition" not in _plan(out)


def test_global_index_empty(spark):
    df = spark.range(0).select(F.col("id").alias("k"))
    assert O.global_index(df, ["k"]).count() == 0


def test_batches_partial_last(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    b = {r["k"]: r["batch_id"] for r in O.assign_batches(df, 4, ["k"]).collect()}
    assert [b[i] for i in range(10)] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_head_fraction_and_drop_tail(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    assert sorted(r["k"] for r in O.head_fraction(df, 25, ["k"]).collect()) == [0, 1]
    assert sorted(r["k"] for r in O.drop_tail(df, 3, ["k"], ["k"]).collect()) == list(range(7))
    assert O.drop_tail(df, 10, ["k"], ["k"]).count() == 0
    assert O.drop_tail(df, 50, ["k"], ["k"]).count() == 0


def test_sample_n_is_seeded_top_n(spark):
    df = spark.range(50).select(F.col("id").alias("k"))
    a = [r["k"] for r in O.sample_n(df, 5, 7, "k").collect()]
    b = [r["k"] for r in O.sample_n(df, 5, 7, "k").collect()]
    assert a == b and len(set(a)) == 5
    assert "TakeOrderedAndProject" in _plan(O.sample_n(df, 5, 7, "k"))


def test_repeat_and_epochs(spark):
    df = spark.range(4).select(F.col("id").alias("k"))
    assert O.repeat_rows(df, 3).count() == 12
    ep = O.expand_epochs(df, 2, 1, "k").collect()
    for e in (0, 1):
        assert sorted(r["pos"] for r in ep if r["epoch"] == e) == [0, 1, 2, 3]


def test_shards(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    out = O.assign_shards(df, 4, "k")
    assert {r["shard"] for r in out.collect()} <= {0, 1, 2, 3}
    assert out.rdd.getNumPartitions() == 4


def test_zip_checked_raises(spark):
    df = spark.createDataFrame([([1, 2], ["a"])], "a array<int>, b array<string>")
    with pytest.raises(Exception):
        df.select(zip_checked("a", "b")).collect()
    ok = spark.createDataFrame([([1], ["a"])], "a array<int>, b array<string>")
    assert ok.select(zip_checked("a", "b")).first()[0][0]["a"] == 1


def test_running_sum(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.lit(1).cast("bigint").alias("v"))
    out = O.running_sum(df, ["v"], ["k"], partition_by=["g"]).collect()
    for r in out:
        assert r["v_cum"] == r["k"] // 2 + 1


def test_mix_keeps_duplicates(spark):
    a = spark.createDataFrame([("x",), ("x",)], "key string")
    b = spark.createDataFrame([("x",)], "key string")
    assert O.mix({"a": a, "b": b}, 1, "key").count() == 3


def test_running_sum_ungrouped_many_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).cast("double").alias("v"))
    out = {r["k"]: r["v_cum"] for r in O.running_sum(df, ["v"], ["k"], num_partitions=7).collect()}
    acc = 0.0
    for k in range(500):
        acc += k % 3
        assert out[k] == acc


def test_range_partitions_bounds(spark):
    df = spark.range(10)
    n = O.range_partitions(df)
    assert 1 <= n <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_large_n_paths_use_the_index(spark, monkeypatch):
    """Above TOPN_ROWS, sampling and hold-out go through the distributed index; same rows."""
    df = spark.range(40).select(F.col("id").alias("k"))
    small_sample = sorted(r["k"] for r in O.sample_n(df, 10, 3, "k").collect())
    small_tail = sorted(r["k"] for r in O.drop_tail(df, 5, ["k"], ["k"]).collect())
    monkeypatch.setattr(O, "TOPN_ROWS", 2)
    assert sorted(r["k"] for r in O.sample_n(df, 10, 3, "k").collect()) == small_sample
    assert sorted(r["k"] for r in O.drop_tail(df, 5, ["k"], ["k"]).collect()) == small_tail == list(range(35))
