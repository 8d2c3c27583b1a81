"""S1-S5 scans and K1-K3 sinks."""

import json
import os
import tempfile

import pytest

from prefengine.operators import order as O
from prefengine.sources import readers as R
from prefengine.sources.sinks import write_jsonl, write_metrics


def test_jsonl_and_json_array(spark):
    d = tempfile.mkdtemp(prefix="prefengine-src-")
    with open(os.path.join(d, "a.jsonl"), "w") as f:
        f.write(json.dumps({"prompt": "p1", "completion": ["x", "y"]}) + "\n")
        f.write(json.dumps({"prompt": "p2", "completion": ["z"]}) + "\n")
    with open(os.path.join(d, "b.json"), "w") as f:
        f.write("[\n" + ",\n".join(json.dumps({"prompt": p, "chosen": "c", "rejected": "r"}, indent=2)
                                   for p in ("q1", "q2")) + "\n]")
    a = R.read_jsonl(spark, os.path.join(d, "a.jsonl"), "prompt string, completion array<string>")
    assert [r["prompt"] for r in a.collect()] == ["p1", "p2"]
    b = R.read_json_array(spark, os.path.join(d, "b.json"), "prompt string, chosen string, rejected string")
    assert sorted(r["prompt"] for r in b.collect()) == ["q1", "q2"]


def test_split_pruning_and_aliases(spark):
    d = tempfile.mkdtemp(prefix="prefengine-split-")
    df = spark.createDataFrame([("train", 1), ("validation", 2), ("validation", 3)], "split string, v int")
    df.write.partitionBy("split").parquet(d + "/t")
    test = R.read_split(spark, d + "/t", "test")
    assert sorted(r["v"] for r in test.collect()) == [2, 3]
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "split" in plan
    assert R.read_split(spark, d + "/t", "train").count() == 1


def test_parquet_scan_prunes_columns(spark):
    from tests.conftest import SF_SMOKE
    df = R.driver_table(spark, SF_SMOKE, "documents").filter("lang = 'en'").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_sinks_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="prefengine-sink-")
    df = spark.createDataFrame([("p", ["a", "b"])], "prompt string, completion array<string>")
    write_jsonl(df, d + "/c")
    back = R.read_jsonl(spark, d + "/c", "prompt string, completion array<string>")
    assert back.first()["completion"] == ["a", "b"]
    m = spark.createDataFrame([("r1", 0, 0.5), ("r2", 0, 0.7)], "run string, step int, loss double")
    write_metrics(m, d + "/m")
    write_metrics(m, d + "/m")
    assert spark.read.parquet(d + "/m").filter("run = 'r1'").count() == 2


def test_head_fraction_order(spark):
    df = spark.range(8).selectExpr("id AS k")
    assert sorted(r["k"] for r in O.head_fraction(df, 50, ["k"]).collect()) == [0, 1, 2, 3]


def test_source_switch(spark):
    d = tempfile.mkdtemp(prefix="prefengine-source-")
    for name, splits in (("a", ["train_prefs", "test_prefs"]), ("b", ["train"])):
        rows = [(s, f"{name}:{s}") for s in splits]
        spark.createDataFrame(rows, "split string, v string").write.partitionBy("split").parquet(f"{d}/{name}")
    sources = {"a": R.Source(f"{d}/a", R.CHAT_PREFERENCE_SPLITS), "b": R.Source(f"{d}/b", elsewhere={"test": "a"}),
               "c": R.Source("", elsewhere={"test": "d"}), "d": R.Source("", elsewhere={"test": "c"})}
    got = {(n, s): [r.v for r in R.read_source(spark, sources, n, s).collect()] for n, s in (("a", "train"), ("b", "train"), ("b", "test"))}
    assert got == {("a", "train"): ["a:train_prefs"], ("b", "train"): ["b:train"], ("b", "test"): ["a:test_prefs"]}
    with pytest.raises(ValueError):
        R.read_source(spark, sources, "c", "test")


def test_json_array_files_round_trip(spark):
    from prefengine.sources.sinks import write_json_arrays

    path = tempfile.mkdtemp(prefix="prefengine-arrays-") + "/t"
    df = spark.createDataFrame([(i, f"line\n{i}", i % 3) for i in range(20)], "k bigint, text string, part int")
    write_json_arrays(df, path, "part", 3)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) == 3
    back = R.read_json_array(spark, path, "k bigint, text string").collect()
    assert sorted((r.k, r.text) for r in back) == [(i, f"line\n{i}") for i in range(20)]


def test_metric_batches_are_idempotent(spark):
    path = tempfile.mkdtemp(prefix="prefengine-metrics-") + "/t"
    df = spark.createDataFrame([(1, 0, 0.5), (2, 0, 0.7)], "run bigint, interval bigint, value double")
    for batch in ("a", "b", "a"):
        write_metrics(df, path, batch=batch)
    assert spark.read.parquet(path).count() == 4
