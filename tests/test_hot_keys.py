"""One conversation or token with a third of all rows."""

import pytest
from pyspark.sql import functions as F

from prefengine.operators import joins as J
from prefengine.operators import tokens as TK
from prefengine.sources import driver_tables as D

CONV = "conv_id long, turn long, role string, text string"


@pytest.fixture
def shuffled(spark):
    """No broadcasts and no adaptive plans: the joins as they are at scale."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def conversation(spark, n=3000):
    hot = [(0, t, "user" if t % 2 == 0 else "assistant", f"h{t}") for t in range(n)]
    cold = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"c{c}t{t}") for c in range(1, 40) for t in range(5)]
    return spark.createDataFrame(hot + cold, CONV).repartition(4), hot + cold


def test_candidates_meet_their_prompt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "PART", 100)
    df, rows = conversation(spark)
    got = D.prompted_candidates(df)
    want = {}
    for c in range(40):
        turns = [(t, role, text) for cc, t, role, text in rows if cc == c]
        first = next(t for t, role, _ in turns if role == "assistant")
        prompt = [text for t, role, text in turns if role == "user" and t < first][-1]
        want |= {(c, i): (prompt, text) for i, text in enumerate(text for t, role, text in turns if role == "assistant")}
    assert {(r["conv_id"], r["cand_idx"]): (r["prompt"], r["completion"]) for r in got.collect()} == want
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_dialogue_turns_meet_in_parts(spark):
    df, rows = conversation(spark, 300)
    got = {r["conv_id"]: r for r in D.dialogue_turns(df).collect()}
    for c in range(40):
        turns = [(t, role, text) for cc, t, role, text in rows if cc == c]
        asst = [(t, text) for t, role, text in turns if role == "assistant"]
        assert got[c]["context"] == [text for t, role, text in turns if role != "system" and t < asst[-1][0]]
        assert (got[c]["chosen_response"], got[c]["rejected_response"]) == (asst[-1][1], asst[0][1])
    plan = D.dialogue_turns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_encode_and_decode_with_a_vocabulary_beyond_a_broadcast(shuffled):
    spark = shuffled
    texts = [(i, "the " * 50 + f"word{i} the", "zz") for i in range(300)] + [(300, "", ""), (301, "unseen the", "x")]
    df = spark.createDataFrame(texts, "k long, a string, b string")
    vocab = TK.fit_vocab(df.filter("k < 300"), "a")
    both = TK.encode_columns(df, ["k"], {"a": "ia", "b": "ib"}, vocab)
    rows = {r["k"]: r for r in both.collect()}
    the = vocab.table.filter("token = 'the'").first()["id"]
    assert the == 4 and all(rows[i]["ia"].count(the) == 51 and len(rows[i]["ia"]) == 52 for i in range(300))
    assert rows[300]["ia"] == [] and rows[301]["ia"] == [TK.UNK, the] and rows[0]["ib"] == [TK.UNK]
    text = {r["k"]: r["t"] for r in TK.decode(both, ["k"], "ia", vocab, out="t").collect()}
    assert text[5] == "the " * 50 + "word5 the" and text[300] == ""
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "_hot" in plan  # frequent tokens apart, the rest by a shuffled join
    assert "SortMergeJoin" in plan


def test_join_lookup_picks_by_size(spark):
    table = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit(1).cast("long").alias("n"))
    left = spark.range(130).select(F.col("id").alias("k"))
    small = J.join_lookup(left, table, "k", "n")
    assert small.columns == ["k", "v"] and "_hot" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert small.filter("v is null").count() == 30


def test_encode_takes_a_tokenizer(spark):
    df = spark.createDataFrame([(1, "a bb")], "k long, t string")
    got = TK.encode(df, ["k"], "t", tokenizer=lambda s: s.map(lambda x: [len(w) for w in x.split()]))
    assert got.first()["t_ids"] == [1, 2]
    with pytest.raises(ValueError):
        TK.encode(df, ["k"], "t")


def test_frequent_tokens_are_found_in_the_row_and_rare_ones_fill_the_gaps(spark, monkeypatch):
    rows = [(i, "the of " * 20 + f"r{i} the x{i}", f"r{i} r{i}") for i in range(60)] + [(60, None, "of nowhere"), (None, "the", "of")]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    vocab = TK.fit_vocab(df.filter("k < 60"), "a")
    ids = {r["token"]: r["id"] for r in vocab.table.collect()}
    exploded = []
    real = J.join_lookup
    monkeypatch.setattr(J, "join_lookup", lambda left, *a: exploded.append(left) or real(left, *a))
    for held in (0, 6, 20, 1000):  # none, the frequent ones, some rare ones, all
        monkeypatch.setattr(J, "held_rows", lambda spark: held)
        exploded.clear()
        both = TK.encode_columns(df, ["k"], {"a": "ia", "b": "ib"}, vocab)
        got = {r["k"]: (r["ia"], r["ib"]) for r in both.collect()}
        assert got[None] == ([], []) and got[60] == ([], [ids["of"], TK.UNK])
        for k, a, b in rows[:60]:
            assert got[k] == ([ids[t] for t in a.split()], [ids[t] for t in b.split()])
        if held == 6:  # the and of, then 20 occurrences of each per row, stay where they are
            assert exploded[0].count() == 60 * 4 + 1
        text = {r["k"]: r["t"] for r in TK.decode(both.filter("k < 60"), ["k"], "ia", vocab, out="t").collect()}
        assert all(text[k] == a for k, a, _ in rows[:60])
    assert not exploded  # a vocabulary that is held whole needs no join


def test_lookup_refuses_a_key_that_is_not_unique(spark, monkeypatch):
    monkeypatch.setattr(J, "held_rows", lambda spark: 4)
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k long, a string")
    with pytest.raises(Exception, match="not unique"):
        TK.encode(df, ["k"], "a", TK.fit_vocab(df, "a")).collect()
