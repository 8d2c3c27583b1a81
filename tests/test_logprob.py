"""L1-L7 on hand-made logits and corpora."""

import math

import pytest
from pyspark.sql import functions as F

from prefengine.functions.math import seq_logp, softplus
from prefengine.operators import joins as J
from prefengine.operators import logprob as L


def test_seq_logp_fixture(spark):
    df = spark.createDataFrame([([[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [5.0, 1.0, 1.0]], [-100, 2, -100]),
                                ([[1.0, 2.0], [3.0, 4.0]], [-100, -100]),
                                ([[1000.0, -1000.0], [-1000.0, 1000.0]], [0, 1])],
                               "logits array<array<double>>, labels array<int>")
    r = df.select(seq_logp("logits", "labels").alias("s"), seq_logp("logits", "labels", average=True).alias("m")).collect()
    assert r[0]["s"] == pytest.approx(-0.407606, abs=1e-6) and r[0]["m"] == pytest.approx(-0.407606, abs=1e-6)
    assert r[1]["s"] == 0.0 and r[1]["m"] is None
    assert r[2]["s"] == pytest.approx(-2000.0) and math.isfinite(r[2]["s"])


def test_temperature(spark):
    df = spark.createDataFrame([([[2.0, 0.0], [0.0, 0.0]], [-100, 0])], "logits array<array<double>>, labels array<int>")
    got = df.select(seq_logp("logits", "labels", temperature=2.0)).first()[0]
    assert got == pytest.approx(1.0 - math.log(math.exp(1.0) + 1.0))


def test_ngram_unseen_and_short(spark):
    train = spark.createDataFrame([("a b a b",), ("a c",)], "text string")
    m = L.fit_ngram(train, "text", n=2, k=1.0)
    assert m.vocab_size == 3
    rows = spark.createDataFrame([(1, "a b"), (2, "z"), (3, "b z"), (4, "")], "k int, text string")
    got = {r["k"]: r["logp"] for r in L.ngram_logp(rows, ["k"], "text", m).collect()}
    # counts: (<s>,a)=2 of <s>=2; (a,b)=2 of a=3; (b,a)=1 of b=1; (a,c)=1; V=3
    assert got[1] == pytest.approx(math.log(3 / 5) + math.log(3 / 6))
    assert got[2] == pytest.approx(math.log(1 / 5))                     # unseen bigram after <s>
    assert got[3] == pytest.approx(math.log(1 / 5) + math.log(1 / 4))   # unseen (b, z) with c(b) = 1
    assert got[4] == 0.0


def test_ngram_trigram_contexts(spark):
    df = spark.createDataFrame([("x y z",)], "text string")
    g = {(r["ctx"], r["tok"]) for r in L._grams(df, "text", 3).collect()}
    assert g == {("<s> <s>", "x"), ("<s> x", "y"), ("x y", "z")}


def test_attach_logps_precomputed_wins(spark):
    pairs = spark.createDataFrame([(1, -1.0, None), (2, None, None)], "k int, ref_chosen_logps double, ref_rejected_logps double")
    ref = spark.createDataFrame([(1, -5.0, -6.0), (2, -7.0, -8.0)], "k int, chosen_logps double, rejected_logps double")
    out = {r["k"]: r for r in L.attach_logps(pairs, ["k"], ref=ref).collect()}
    assert out[1]["ref_chosen_logps"] == -1.0 and out[1]["ref_rejected_logps"] == -6.0
    assert out[2]["data_chosen_logps"] == -7.0  # data falls back to reference


def test_pivot_and_packed(spark):
    long = spark.createDataFrame([(1, "chosen", -1.0), (1, "rejected", -2.0)], "k int, side string, v double")
    r = L.pivot_sides(long, ["k"], "side", "v").first()
    assert (r["chosen_logps"], r["rejected_logps"]) == (-1.0, -2.0)
    toks = spark.createDataFrame([(0, 1, -1.0), (0, 1, -2.0), (0, 2, -0.5)], "b int, doc int, lp double")
    assert {r["doc"]: r["logp"] for r in L.packed_logp(toks, ["b"], "doc", "lp").collect()} == {1: -3.0, 2: -0.5}


def test_softplus_stable(spark):
    r = spark.range(1).select(softplus(F.lit(1000.0)), softplus(F.lit(-1000.0)), softplus(F.lit(0.0))).first()
    assert r[0] == pytest.approx(1000.0) and r[1] == pytest.approx(0.0) and r[2] == pytest.approx(math.log(2))


def test_many_models_one_table_and_hot_contexts_apart(spark):
    """Counts of all models come from one table; frequent keys are joined by broadcast, so the
    shuffled side never holds them, and scores equal those of models fitted one by one."""
    rows = [(i, f"the w{i} the v{i % 7} of the x{i % 3}") for i in range(300)] + [(900, "")]
    df = spark.createDataFrame(rows, "k int, text string")
    both = L.fit_ngrams([(df, {"a": F.lit(True), "b": F.col("k") % 2 == 0})], "text")
    single = {"a": L.fit_ngram(df, "text"), "b": L.fit_ngram(df.filter("k % 2 = 0"), "text")}
    assert both.vocab_sizes == {n: m.vocab_size for n, m in single.items()}
    got = {r["k"]: r for r in L.ngram_logps(df, ["k"], "text", both).collect()}
    for name, m in single.items():
        for r in L.ngram_logp(df, ["k"], "text", m).collect():
            assert got[r["k"]][name] == pytest.approx(r["logp"])

    grams = L._grams(df, "text", 2, keep=["k"])
    joined = L.join_counts(grams, both.contexts, ["ctx"])
    assert joined.count() == grams.count() and joined.filter("c_a is null").count() == 0
    total = both.contexts.agg(F.sum("c_all")).first()[0]
    hot = both.contexts.filter(F.col("c_all") >= total * L.HOT_SHARE)
    assert 1 <= hot.count() <= 1 / L.HOT_SHARE and hot.filter("ctx = 'the'").count() == 1
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Join LeftOuter") == 2  # cold rows: no hot key found, then the table


def test_ngrams_and_contexts_meet_their_own_table(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b a b c"), (2, "b z"), (3, "")], "k long, t string")
    model = L.fit_ngram(df.filter("k = 1"), "t", k=0.5)
    lefts, real = [], J.join_counts
    monkeypatch.setattr(L, "join_counts", lambda left, *a: lefts.append(left.columns) or real(left, *a))
    got = {r["k"]: (r["logp"], r["n"]) for r in L.ngram_logps(df, ["k"], "t", model, with_length="n").collect()}
    assert lefts == [["k", "ctx", "tok"], ["k", "ctx"]]  # the second join does not carry the first one's rows
    grams = {("<s>", "a"): 1, ("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 1}
    ctx = {"<s>": 1, "a": 2, "b": 2}
    def want(words):
        return sum(math.log((grams.get(g, 0) + 0.5) / (ctx.get(g[0], 0) + 1.5)) for g in zip(["<s>", *words], words))
    assert got[1] == (pytest.approx(want("a b a b c".split())), 5) and got[2] == (pytest.approx(want(["b", "z"])), 2) and got[3] == (0.0, 0)
    assert J._hot_from(model.ngrams, 2) == 1 and J._hot_from(model.ngrams, 1) == 1  # shares of a tiny table are all hot
    counts = spark.createDataFrame([(5000,), (3,), (2,), (2,), (1,)], "c_all long")
    assert [J._hot_from(counts, n) for n in (0, 1, 2, 3, 4, 9)] == [pytest.approx(5.008), pytest.approx(5.008), 3, 3, 2, 1]
    with pytest.raises(ValueError):
        L.fit_ngram(df, "t", k=0)
