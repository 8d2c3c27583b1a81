"""Streams with state: pairs of samples, means by count, versioned results."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from prefengine.operators import metrics as MT
from prefengine.session import shared_dir
from prefengine.sources.versions import VersionedTable
from prefengine.streaming import jobs as S

SAMPLES = "p string, k int, text string, score double, at long"


def arrive(spark, path, rows):
    df = spark.createDataFrame(rows, SAMPLES).withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)).drop("at")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def local(path):
    return path.removeprefix("file:")


def test_pairs_over_micro_batches(spark):
    src, out, ck = (shared_dir(spark, f"t-{x}") for x in ("samples", "pairs", "pairs-ck"))
    lost, lost_ck = shared_dir(spark, "t-lost"), shared_dir(spark, "t-lost-ck")
    hour = 3600
    batches = [
        [("a", 0, "a0", 1.0, 0), ("b", 0, "b0", 5.0, 10), ("c", 1, "c1", 2.0, 20), ("tie", 0, "t0", 1.0, 0), ("tie", 1, "t1", 1.0, 0)],
        [("a", 0, "again", 9.0, 5), ("c", 0, "c0", 3.0, 30)],                # a duplicate first sample; c complete
        [("a", 1, "a1", 4.0, 40), ("a", 1, "a1", 4.0, 41)],                   # a complete, its second twice at once
        [("a", 1, "late copy", 8.0, 50), ("clock", 0, "x", 0.0, 5 * hour)],   # the watermark passes b's wait
        [("b", 1, "b1", 1.0, 60), ("d", 0, "d0", 1.0, 5 * hour)],             # b's partner is too late
        [("d", 1, "d1", 2.0, 5 * hour + 9), ("end", 0, "y", 0.0, 12 * hour)],
        [("end2", 0, "z", 0.0, 13 * hour)],
    ]
    seen = []
    for rows in batches:
        schema = arrive(spark, src, rows)
        stream = S.file_stream(spark, src, "parquet", schema)
        S.run_append(S.online_label_stream(stream, ["p"], "k", "text", wait="1 hour"), out, ck, state_partitions=2)
        S.run_append(S.online_pair_stream(stream, ["p"], "k", ["text"], wait="1 hour", unpaired=True), lost, lost_ck, state_partitions=2)
        seen.append(spark.read.parquet(out).count())
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", "a1", "a0", 4.0, 1.0), ("c", "c0", "c1", 3.0, 2.0), ("d", "d1", "d0", 2.0, 1.0), ("tie", "t0", "t1", 1.0, 1.0)]
    assert seen == [1, 2, 3, 3, 3, 4, 4]  # each pair as soon as it is complete, and once
    gone = {(r["p"], r["text_0"], r["text_1"]) for r in spark.read.parquet(lost).collect()}
    assert ("b", "b0", None) in gone and not any(p in ("a", "c", "d", "tie") for p, _, _ in gone)


LOG = "run int, idx long, value decimal(10,2), hit decimal(10,2)"


def log_rows(n=500, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([0, 0, 0, 1, 2]), i, f"{rng.random() * 9:.2f}", f"{rng.random():.2f}" if i % 3 else None) for i in range(n)]


def frame(spark, rows):
    from decimal import Decimal
    return spark.createDataFrame([(r, i, Decimal(v), None if h is None else Decimal(h)) for r, i, v, h in rows], LOG)


def means(spark):
    return S.IntervalMeans(spark, shared_dir(spark, "t-intervals"), "run", ["idx"], ["value", "hit"], 4, 2, run_type="int")


def listed(df):
    return sorted((r["run"], r["interval"], r["examples"], r["value"], r["hit"]) for r in df.collect())


def batch_twin(spark, rows):
    return listed(MT.interval_means(frame(spark, rows), ["value", "hit"], 4, 2, ["idx"], by=["run"], scale=2))


def test_interval_means_whatever_the_split(spark):
    rows = log_rows()
    want = batch_twin(spark, rows)
    for cuts in ([0, 500], [0, 1, 2, 250, 499, 500], [0, 120, 120, 381, 500]):
        m = means(spark)
        for epoch, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            m.take(frame(spark, rows[lo:hi]), epoch)
        assert listed(m.records(open_intervals=True)) == want
        assert listed(m.records()) == [r for r in want if r[2] == 8]


def test_interval_means_as_a_stream_that_fails_and_repeats(spark, monkeypatch):
    rows = log_rows(300, 2)
    src, ck, m = shared_dir(spark, "t-log"), shared_dir(spark, "t-log-ck"), means(spark)
    schema = frame(spark, rows).schema
    write = VersionedTable.write
    for k in range(3):
        frame(spark, rows[k * 100:(k + 1) * 100]).coalesce(1).write.mode("append").parquet(src)
        if k == 1:  # the job ends after the records, before the counters
            def fail(self, df, epoch):
                raise RuntimeError("ended")
            monkeypatch.setattr(VersionedTable, "write", fail)
            with pytest.raises(Exception):
                m.run_stream(S.file_stream(spark, src, "parquet", schema), ck)
            monkeypatch.setattr(VersionedTable, "write", write)
            assert listed(m.records(True)) == batch_twin(spark, rows[:100])  # readers see the first micro-batch only
        m.run_stream(S.file_stream(spark, src, "parquet", schema), ck)
    assert listed(m.records(True)) == batch_twin(spark, rows)
    m.take(frame(spark, rows[200:]), 2)  # the last micro-batch once more
    assert listed(m.records(True)) == batch_twin(spark, rows)


def test_versions(spark):
    t = VersionedTable(spark, shared_dir(spark, "t-versions"), "k int, v int", keep=2)
    one = lambda v: spark.createDataFrame([(1, v)], "k int, v int")
    assert t.read().collect() == [] and t.newest() is None
    t.write(one(10), 0)
    t.write(one(11), 1)
    bad = one(12).withColumn("v", F.raise_error(F.lit("ended")).cast("int"))
    with pytest.raises(Exception):
        t.write(bad, 2)
    assert t.read().first()["v"] == 11 and t.epochs() == [0, 1]
    with pytest.raises(Exception):
        t.write(bad, 1)  # done again and ended: the version before is read
    assert t.read().first()["v"] == 10
    t.write(one(13), 1)
    t.write(one(14), 2)
    t.write(one(15), 2)
    assert t.read().first()["v"] == 15 and t.read(before=2).first()["v"] == 13 and t.epochs() == [1, 2]
    with pytest.raises(ValueError):
        t.write(one(1), 0)


def test_accuracy_in_update_mode_done_again(spark):
    schema = "run int, chosen_score double, rejected_score double"
    src, ck = shared_dir(spark, "t-acc-src"), shared_dir(spark, "t-acc-ck")
    table = VersionedTable(spark, shared_dir(spark, "t-acc-table"), "run int, accuracy double, n_pairs bigint")

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        return go()

    def go():
        S.run_update(S.accuracy_stream(S.file_stream(spark, src, "parquet", schema)), table, ["run"], ck, state_partitions=2)
        return {r["run"]: (r["accuracy"], r["n_pairs"]) for r in table.read().collect()}

    assert add([(0, 2.0, 1.0), (1, 1.0, 2.0)]) == {0: (1.0, 1), 1: (0.0, 1)}
    assert add([(0, 0.0, 1.0), (2, 3.0, 0.0)]) == {0: (0.5, 2), 1: (0.0, 1), 2: (1.0, 1)}  # run 1 has not changed and stays
    last = max((int(os.path.basename(f)), f) for f in glob.glob(f"{local(ck)}/commits/*") if os.path.basename(f).isdigit())[1]
    os.remove(last)  # the job ended before it could commit its last micro-batch
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    assert go() == {0: (0.5, 2), 1: (0.0, 1), 2: (1.0, 1)}
    assert add([(1, 5.0, 1.0)]) == {0: (0.5, 2), 1: (0.5, 2), 2: (1.0, 1)}
