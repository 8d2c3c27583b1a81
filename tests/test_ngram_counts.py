"""The count tables behind the n-gram models."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefengine.operators import joins as J
from prefengine.operators import logprob as L
from prefengine.operators import ngram_counts as C


def test_counts_are_shuffled_once_and_match_sql_counts(spark):
    """Counts of all kinds come from one shuffle of blocks and meet scored n-grams without another; they are those of the
    exploded places, also with odd white space, empty and null texts, and words of the filler's name."""
    rows = [(i, f"The w{i % 40}\x0bthe\tÉTÉ <s> w{i % 7}  ") for i in range(400)] + [(900, ""), (901, None), (902, " \n"), (903, "<s> x")]
    df = spark.createDataFrame(rows, "k long, text string")
    for n in (1, 2, 3):
        model = L.fit_ngrams([(df, {"a": F.lit(True), "b": F.col("k") % 2 == 0}), (df.filter("k < 9"), {"b": F.lit(True)})], "text", n=n)
        places = L._grams(df, "text", n, keep=["k"]).withColumns({"a": F.lit(1), "b": (F.col("k") % 2 == 0).cast("int")})
        places = places.unionByName(L._grams(df.filter("k < 9"), "text", n, keep=["k"]).withColumns({"a": F.lit(0), "b": F.lit(1)}))
        sums = [F.sum("a").alias("c_a"), F.sum("b").alias("c_b"), F.count(F.lit(1)).alias("c_all")]
        key = [F.xxhash64(c).alias(c) for c in ("ctx", "tok")]
        assert sorted(model.ngrams.collect()) == sorted(places.groupBy("ctx", "tok").agg(*sums).select(*key, "c_a", "c_b", "c_all").collect())
        assert sorted(model.contexts.collect()) == sorted(places.groupBy("ctx").agg(*sums).collect())
        for m in ("a", "b"):
            assert model.vocab_sizes[m] == places.filter(f"{m} = 1").select("tok").distinct().count()

    left = spark.range(100).select(F.xxhash64(F.col("id").cast("string")).alias("ctx"), F.xxhash64("id").alias("tok"))
    plan = J.join_counts(left, model.ngrams, ["ctx", "tok"], True)._jdf.queryExecution().executedPlan().toString()
    joined = plan[plan.index("ShuffledHashJoin"):]
    assert "BuildLeft" in joined and joined.count("Exchange hashpartitioning") == 1  # the scored side alone
    table = model.ngrams.inputFiles()
    assert len({f.rsplit("_", 1)[1].split(".")[0] for f in table}) == len(table)  # blocks land in their own bucket


def test_blocks_of_more_rows_than_a_chunk(spark, monkeypatch):
    """Sums kept while blocks arrive are the same as sums of all of them."""
    texts = pa.table({"text": [f"a b{i % 5} a" for i in range(50)], "models": [1] * 50})
    blocks = [b for _ in range(9) for b in C._blocks(C._counts(texts, 1, 2, "<s>", ["c_m", "c_all"]), 1)]
    monkeypatch.setattr(C, "CHUNK_ROWS", 8)
    out = pa.Table.from_batches(list(C._adder(["c_m", "c_all"])(iter(blocks))))
    kinds = {k: sum(r["c_m"] for r in out.to_pylist() if r["kind"] == k) for k in (C.CONTEXT, C.TOKEN, C.NGRAM)}
    assert kinds == dict.fromkeys(kinds, 9 * 150) and out.num_rows == 7 + 6 + 11
    same = C._table(["c_m", "c_all"], [np.array([1, 1])] * 2, ctx=np.array([7, 7]), word=pa.array(["x", "y"]))
    with pytest.raises(ValueError, match="one hash"):
        list(C._adder(["c_m", "c_all"])(C._blocks(iter([(C.CONTEXT, same)]), 1)))
