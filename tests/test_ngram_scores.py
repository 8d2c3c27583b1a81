"""Texts scored by chunks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefengine.operators import logprob as L
from prefengine.operators import ngram_counts as C
from prefengine.operators import ngram_scores as S
from prefengine.session import materialize, materialize_buckets


@pytest.mark.parametrize("n", [1, 2, 3])
def test_chunks_score_as_joined_rows_do(spark, monkeypatch, n):
    """Both ways give the same sums, whatever the size of a chunk, the blocks' form and what tasks hold; with odd white space,
    empty and null texts, texts that were not counted and a text more often than once."""
    rows = [(i, i % 3, f"The w{i % 40}\x0bthe\tÉTÉ <s> w{i % 7}  the w{i}") for i in range(300)] + [(900, 0, ""), (901, 0, None), (902, 0, " \n"), (903, 1, "nowhere <s>")]
    df = materialize(spark.createDataFrame(rows, "k long, j int, text string").repartition(3))
    models = L.fit_ngrams([(df.filter("k % 2 = 0"), {"a": F.lit(True)}), (df.filter("k < 50"), {"a": F.lit(True), "b": F.lit(True)})], "text", n=n, k=0.5)

    def scored():
        return {(r["k"], r["j"]): (r["n"], r["a"], r["b"]) for r in L.ngram_logps(df, ["k", "j"], "text", models, with_length="n").collect()}
    want = scored()
    assert want[900, 0] == (0, 0.0, 0.0) and want[903, 1][0] == 2 and len(want) == 304
    monkeypatch.setattr(L, "ROW_BYTES", -1)
    for held, place_bytes, most, turns in ((0, 0, 1000, 1), (0, 1e9, 1000, 3), (200, 1.5, 5, 2), (10**6, 1.5, 1000, 2)):
        monkeypatch.setattr(L, "TURNS", turns)
        monkeypatch.setattr(L, "held_rows", lambda spark: held)
        monkeypatch.setattr(S, "PLACE_BYTES", place_bytes)
        monkeypatch.setattr(S, "chunks", lambda batches, rows: C.chunks(batches, most))
        got = scored()
        assert got.keys() == want.keys()
        for key, values in want.items():
            assert got[key][0] == values[0] and got[key][1:] == pytest.approx(values[1:])


def test_an_ngram_is_asked_for_once_a_chunk(monkeypatch):
    """Two samples of a text, and texts that repeat, add places of two bytes but no rows to what is shuffled."""
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(words[k:] + words[:k]) for _ in range(30) for k in (0, 1)]
    table = pa.table({"k": range(len(texts)), "_text": texts})
    hot = S._Hot(pa.table({c: pa.array([], pa.int64()) for c in ("ctx", "tok", "c_a")}), ["ctx", "tok"], ["c_a"], [1.0])
    own, *asks = S._asks(table, ["k"], ("a",), 2, "<s>", ["ctx", "tok"], hot, 5)
    asks = pa.Table.from_batches(asks)
    own = own.select(["chunk", "data"]).append_column("c_a", pa.array([None], pa.int64()))
    assert own.column("chunk").to_pylist() == [~5] and asks.num_rows == 49 + 1 + 2  # pairs, the last with the first, two starts
    assert sum(len(x) for x in asks.column("data").to_pylist()) == 2 * 60 * 50
    met = asks.select(["chunk", "data"]).append_column("c_a", pa.array(np.arange(52) % 3 + 1))
    for place_bytes in (1e9, 0):  # as sums of rows, as places by their counts
        monkeypatch.setattr(S, "PLACE_BYTES", place_bytes)
        blocks = list(S._packer(["c_a"], [1.0])(iter([*met.to_batches(), own])))
        assert sum(b.num_rows for b in blocks) == 2 and sum(b.nbytes for b in blocks) < 4000
        rows = pa.Table.from_batches(S._summer(["k"], ("a",), [1.0])(iter(blocks))).to_pylist()
        assert len(rows) == 60 and {r["_m"] for r in rows} == {50}
        want = np.zeros(60)
        for data, log in zip(asks.column("data").to_pylist(), np.log(np.arange(52) % 3 + 2.0)):
            np.add.at(want, np.frombuffer(data, "<u2"), log)
        assert [r["a"] for r in rows] == pytest.approx(want.tolist())
    halves = [pa.Table.from_batches(list(S._asks(table, ["k"], ("a",), 2, "<s>", ["ctx", "tok"], hot, 5, (i, 2)))[1:]) for i in (0, 1)]
    assert 0 < len(halves[0]) < 52 and sorted(pa.concat_tables(halves).to_pylist(), key=str) == sorted(asks.to_pylist(), key=str)
    part = list(S._packer(["c_a"], [1.0])(iter([*met.slice(0, 40).to_batches(), own])))
    with pytest.raises(ValueError, match="missing"):
        list(S._summer(["k"], ("a",), [1.0])(iter(part)))


def test_chunks_keep_rows_in_order(monkeypatch):
    batches = [pa.record_batch({"k": range(i, i + 40)}) for i in range(0, 200, 40)]
    monkeypatch.setattr(C, "CHUNK_BYTES", 400)
    for most, sizes in ((None, 50), (30, 30), (7, 7)):
        got = list(C.chunks(iter(batches), most))
        assert [k for t in got for k in t.column("k").to_pylist()] == list(range(200)) and max(map(len, got)) <= max(sizes, 80)
        assert most is None or max(map(len, got)) == most


def test_a_written_table_leaves_no_shuffle_files(spark):
    def shuffles():
        return set(str(spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().mkString(",")).split(",")) - {""}
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), (F.col("id") % 2).alias("f"))
    before = shuffles()
    kept = materialize(df.groupBy("k").count(), codec="zstd")
    assert shuffles() <= before
    dealt = materialize_buckets(df.repartition(4, "k"), "dealt", "f", ["k"], 4)
    assert shuffles() <= before
    assert kept.count() == 7 and dealt.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
