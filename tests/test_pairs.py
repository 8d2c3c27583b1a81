"""E1, E2, R1-R6, N2 on hand-made rows."""

import itertools
import math

from pyspark.sql import functions as F

from prefengine.operators import pairs as P


def test_candidate_pairs_match_itertools(spark):
    rows = [(n, [f"c{i}" for i in range(n)]) for n in (0, 1, 2, 3, 4, 7)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, completion array<string>")
    for k in (4, 16):
        got = {}
        for r in P.candidate_pairs(df, k).collect():
            got.setdefault(r["id"], []).append((r["pair_idx"], r["chosen"], r["rejected"]))
        for n, cands in rows:
            want = list(itertools.combinations(cands or [], 2))[:k]
            have = [(c, d) for _, c, d in sorted(got.get(n, []))]
            assert have == want, (n, k)


def test_candidate_pairs_duplicates_kept(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"])], "id int, completion array<string>")
    assert [(r["chosen"], r["rejected"]) for r in P.candidate_pairs(df, 4).orderBy("pair_idx").collect()] == \
        [("a", "a"), ("a", "b"), ("a", "b")]


def test_flatten_candidates(spark):
    df = spark.createDataFrame([("p", ["x", "y"])], "prompt string, completion array<string>")
    assert [(r["cand_idx"], r["completion"]) for r in P.flatten_candidates(df).collect()] == [(0, "x"), (1, "y")]


def test_label_tie_rules(spark):
    rows = [("a", "b", 1.0, 1.0), ("a", "b", 2.0, 1.0), ("a", "b", -1.0, 3.0),
            ("a", "b", float("nan"), 1.0), ("a", "b", None, 1.0)]
    df = spark.createDataFrame(rows, "chosen string, rejected string, chosen_score double, rejected_score double")
    off = [(r["chosen"], r["chosen_score"], r["rejected_score"]) for r in P.label_pairs(df, tie="second").collect()]
    on = [(r["chosen"], r["chosen_score"]) for r in P.label_pairs(df, tie="first").collect()]
    assert off == [("b", 1.0, 1.0), ("a", 2.0, 1.0), ("b", 3.0, -1.0)]
    assert on == [("a", 1.0), ("a", 2.0), ("b", 3.0)]


def test_label_symmetric_under_swap_except_ties(spark):
    rows = [(f"t{i}", f"u{i}", float(i % 3), float(i % 4)) for i in range(12)]
    cols = "chosen string, rejected string, chosen_score double, rejected_score double"
    a = {(r["chosen"], r["rejected"]) for r in P.label_pairs(spark.createDataFrame(rows, cols)).collect()}
    sw = [(b, a_, sb, sa) for a_, b, sa, sb in rows]
    b = {(r["chosen"], r["rejected"]) for r in P.label_pairs(spark.createDataFrame(sw, cols)).collect()}
    ties = {(r[0], r[1]) for r in rows if r[2] == r[3]} | {(r[1], r[0]) for r in rows if r[2] == r[3]}
    assert {x for x in a if x not in ties} == {x for x in b if x not in ties}


def test_penalise_unterminated(spark):
    df = spark.createDataFrame([([5, 2], 0.7), ([5, 6], 0.7), ([2], 0.1)], "ids array<int>, s double")
    from prefengine.functions.arrays import has_token
    got = [r[0] for r in df.select(P.penalise_unterminated("s", has_token("ids", 2))).collect()]
    assert got == [0.7, -1.0, 0.1]


def test_agreement_and_pair_samples(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 3.0), (2.0, 2.0), (5.0, 0.0)], "chosen_score double, rejected_score double")
    r = P.agreement(df).first()
    assert math.isclose(r["accuracy"], 0.5) and r["n_pairs"] == 4
    s = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z")], "k int, r int, t string")
    out = P.pair_samples(s, ["k"], "r", ["t"]).collect()
    assert [(o["k"], o["t_0"], o["t_1"]) for o in out] == [(1, "x", "y")]


def test_score_pairs(spark):
    pairs = spark.createDataFrame([(1, 10, 11)], "conv_id int, a int, b int")
    scores = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.25)], "conv_id int, turn int, score double")
    r = P.score_pairs(pairs, scores, ["conv_id", "turn"], ["conv_id", "a"], ["conv_id", "b"]).first()
    assert (r["chosen_score"], r["rejected_score"]) == (0.5, 0.25)
    assert math.isclose(pairs.select(P.implicit_reward(F.lit(2.0), F.lit(1.0), 0.1)).first()[0], 0.1)


def test_candidate_sets_limit_before_shuffle(spark):
    """First K+1 candidates per conversation: the group limit runs map-side, before the
    exchange, so a conversation with very many turns ships at most K+1 rows per task."""
    from prefengine.sources import driver_tables as D
    rows = [(0, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(400)] + \
           [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    sets = D.candidate_sets(conv, max_candidates=5)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = {r["conv_id"]: (r["n_candidates"], r["completion"]) for r in sets.collect()}
    assert got[0] == (200, ["t1", "t3", "t5", "t7", "t9"]) and got[1] == (1, ["a"])
    pairs = P.candidate_pairs(sets.select("conv_id", "completion"), 4)
    assert [(r["chosen"], r["rejected"]) for r in pairs.filter("conv_id = 0").orderBy("pair_idx").collect()] == \
        [("t1", "t3"), ("t1", "t5"), ("t1", "t7"), ("t1", "t9")]


def test_candidate_pairs_all_small_k_and_n(spark):
    """Every K in 1..8 against every list length 0..12: the bounded in-row generation (i < K,
    j <= i + K) returns exactly the first K lexicographic combinations."""
    rows = [(n, [f"c{i}" for i in range(n)]) for n in range(13)]
    df = spark.createDataFrame(rows, "id int, completion array<string>").cache()
    for k in range(1, 9):
        got = {}
        for r in P.candidate_pairs(df, k).collect():
            got.setdefault(r["id"], []).append((r["pair_idx"], r["i"], r["j"]))
        for n, _ in rows:
            want = list(itertools.combinations(range(n), 2))[:k]
            assert [(i, j) for _, i, j in sorted(got.get(n, []))] == want, (n, k)


def test_label_unscored_can_raise(spark):
    df = spark.createDataFrame([("a", "b", 1.0, None)], "chosen string, rejected string, chosen_score double, rejected_score double")
    assert P.label_pairs(df).count() == 0
    try:
        P.label_pairs(df, unscored="raise").collect()
    except Exception as e:
        assert "no score" in str(e)
    else:
        raise AssertionError("a pair without a score must raise")
