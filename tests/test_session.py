"""Shared folders, written intermediates and the index over keys only."""

import pytest
from pyspark.sql import functions as F

from prefengine import session as S
from prefengine.operators import order as O


class _Cluster:
    """A session that is not local and names no checkpoint folder."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(_key, default=None):
            return default


def test_no_private_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.checkpoint_root(_Cluster())


def test_materialize_and_release(spark):
    df = S.materialize(spark.range(10).withColumn("x", F.rand()))
    assert df.count() == 10 and df.collect() == df.collect()
    assert S.release(spark) >= 1 and not S._folders
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_index_checkpoints_keys_only(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    widths, real = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, eager=True: widths.append(set(self.columns)) or real(self, eager))
    df = spark.range(50).select(F.col("id").alias("k"), F.lit("x" * 1000).alias("text"))
    out = O.shuffled_index(df, 1, "k")
    assert out.columns == ["k", "text", "pos"] and sorted(r.pos for r in out.collect()) == list(range(50))
    assert O.mix({"a": df, "b": df}, 1, "k").count() == 100
    O.assign_batches(df, 7, ["k"], key="k").count(), O.head_fraction(df, 10, ["k"], key="k").count()
    assert widths and all("text" not in w for w in widths)


def test_partitions_follow_bytes(spark, monkeypatch):
    df = spark.range(100_000)
    monkeypatch.setattr(O, "RANGE_PARTITION_BYTES", 10_000)
    assert O.range_partitions(df) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_checkpoint_counts_by_its_files(spark):
    S.checkpoint_root(spark)
    left, right = (spark.range(20_000).select((F.col("id") % 10_000).alias("k"), F.md5(F.col("id").cast("string")).alias(c)) for c in "xy")
    joined = left.join(right, "k").checkpoint()
    files = S.plan_bytes(joined)
    assert 0 < files < 20_000_000
    assert O.range_partitions(joined.select("k")) <= spark.sparkContext.defaultParallelism


def test_shards_have_a_partition_each(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    out = O.assign_shards(df, 7, "k").select("shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert sorted((r.shard, r.p) for r in out) == [(i, i) for i in range(7)]


def test_running_sum_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).select(F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("g"), F.col("id").alias("k"),
                                     F.when(F.col("id") % 5 != 0, F.lit(2)).alias("v"))
        got = {r.k: r.v_cum for r in O.running_sum(df, ["v"], ["k"], partition_by=["g"], num_partitions=4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    acc = {}
    for k in range(300):
        acc[k % 3] = acc.get(k % 3, 0) + (2 if k % 5 else 0)
        assert got[k] == acc[k % 3]
