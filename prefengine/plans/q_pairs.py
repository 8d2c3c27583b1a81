"""Queries for candidate expansion, pair generation, scoring and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefengine.functions.arrays import has_token, truncate_after
from prefengine.operators import pairs as P
from prefengine.operators.tokens import EOS, PAD, SPECIALS, token_list
from prefengine.operators import logprob as L
from prefengine.plans.q_logprob import fit_models
from prefengine.plans.registry import (register, sql_ngram_model, sql_ngram_score, sql_r, sql_text_score,
                                       sql_tokens, table)
from prefengine.sources import driver_tables as D

BETA = 0.1
GEN_BUDGET = 1024


def _conv(spark, sf):
    return table(spark, sf, "conversations")


_PROMPTED = """
firsts AS (SELECT conv_id, min(turn) AS first_turn, count(*) AS n_candidates
           FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
prompted AS (SELECT f.conv_id, f.n_candidates,
                    (SELECT arg_max(u.text, u.turn) FROM conversations u
                     WHERE u.conv_id = f.conv_id AND u.role = 'user' AND u.turn < f.first_turn) AS prompt
             FROM firsts f
             WHERE EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = f.conv_id
                           AND u.role = 'user' AND u.turn < f.first_turn)),
ranked AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r
           FROM conversations WHERE role = 'assistant')"""


def _pairs_sql_k(k: int) -> str:
    return f"""
WITH {_PROMPTED},
pairs AS (SELECT x.conv_id, x.r AS i, y.r AS j, x.text AS chosen, y.text AS rejected,
                 row_number() OVER (PARTITION BY x.conv_id ORDER BY x.r, y.r) - 1 AS pair_idx
          FROM ranked x JOIN ranked y ON x.conv_id = y.conv_id AND x.r < y.r
          WHERE x.conv_id IN (SELECT conv_id FROM prompted))
SELECT conv_id, pair_idx, i, j, chosen, rejected FROM pairs WHERE pair_idx < {k}
"""


# -- E1: one row per (prompt, completion)
@register("flatten_candidates", f"""
WITH {_PROMPTED}
SELECT p.conv_id, p.prompt, r.r AS cand_idx, r.text AS completion
FROM prompted p JOIN ranked r USING (conv_id)
""")
def flatten_candidates(spark, sf):
    conv = _conv(spark, sf)
    # candidates come as rows: gathering them into sets only to explode these again would put a
    # whole conversation into one row (flatten_candidates on real sets: refined_summaries, udf_generate)
    return D.prompted_candidates(conv)


def _pairs(spark, sf, k):
    sets = D.candidate_sets(_conv(spark, sf), max_candidates=k + 1).select("conv_id", "completion")
    return P.candidate_pairs(sets, k).select("conv_id", "pair_idx", "i", "j", "chosen", "rejected")


# -- E2: first K 2-combinations per prompt, lexicographic (K = 4 and K = 16)
@register("candidate_pairs", _pairs_sql_k(4))
def candidate_pairs(spark, sf):
    return _pairs(spark, sf, 4)


@register("candidate_pairs_k16", _pairs_sql_k(16))
def candidate_pairs_k16(spark, sf):
    return _pairs(spark, sf, 16)


def _turn_pairs(spark, sf, k=4):
    conv = _conv(spark, sf)
    sets = D.candidate_sets(conv, max_candidates=k + 1).select("conv_id", "n_candidates", "turns")
    pairs = P.candidate_pairs(sets, k, col="turns", first="first_turn", second="second_turn")
    return P.score_pairs(pairs, D.turn_scores(conv), ["conv_id", "turn"], ["conv_id", "first_turn"],
                         ["conv_id", "second_turn"])


_SCORED_SQL = f"""
WITH {_PROMPTED},
sc AS (SELECT conv_id, turn, r, {sql_text_score('text')} AS score FROM ranked),
pairs AS (SELECT x.conv_id, x.turn AS first_turn, y.turn AS second_turn, x.score AS chosen_score, y.score AS rejected_score,
                 row_number() OVER (PARTITION BY x.conv_id ORDER BY x.r, y.r) - 1 AS pair_idx
          FROM sc x JOIN sc y ON x.conv_id = y.conv_id AND x.r < y.r
          WHERE x.conv_id IN (SELECT conv_id FROM prompted)),
scored AS (SELECT * FROM pairs WHERE pair_idx < 4)"""


# -- R1: score both sides by equi-joins to the score table
@register("score_pairs", f"""{_SCORED_SQL}
SELECT conv_id, pair_idx, first_turn, second_turn, chosen_score, rejected_score FROM scored
""")
def score_pairs(spark, sf):
    return _turn_pairs(spark, sf).select("conv_id", "pair_idx", "first_turn", "second_turn",
                                         "chosen_score", "rejected_score")


# -- R3: offline labelling, strict > (a tie makes the second response chosen)
@register("label_offline", f"""{_SCORED_SQL}
SELECT conv_id, pair_idx,
       CASE WHEN chosen_score > rejected_score THEN first_turn ELSE second_turn END AS chosen_turn,
       CASE WHEN chosen_score > rejected_score THEN second_turn ELSE first_turn END AS rejected_turn,
       greatest(chosen_score, rejected_score) AS chosen_score, least(chosen_score, rejected_score) AS rejected_score
FROM scored
""")
def label_offline(spark, sf):
    lab = P.label_pairs(_turn_pairs(spark, sf), tie="second", unscored="raise", first="first_turn", second="second_turn")
    return lab.select("conv_id", "pair_idx", F.col("chosen").alias("chosen_turn"),
                      F.col("rejected").alias("rejected_turn"), "chosen_score", "rejected_score")


# -- R6: label agreement (share of pairs where the first outscored the second)
@register("agreement", f"""{_SCORED_SQL}
SELECT {sql_r('avg(CASE WHEN chosen_score > rejected_score THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n_pairs
FROM scored
""")
def agreement(spark, sf):
    out = P.agreement(_turn_pairs(spark, sf))
    return out.select(F.round("accuracy", 6).alias("accuracy"), "n_pairs")


# -- N2 + R5: two samples per prompt, online choice with >= (first wins a tie)
@register("label_online", f"""
WITH {_PROMPTED},
two AS (SELECT conv_id,
               max(CASE WHEN r = 0 THEN turn END) AS t0, max(CASE WHEN r = 1 THEN turn END) AS t1,
               max(CASE WHEN r = 0 THEN {sql_text_score('text')} END) AS s0,
               max(CASE WHEN r = 1 THEN {sql_text_score('text')} END) AS s1
        FROM ranked WHERE r < 2 GROUP BY conv_id HAVING count(*) = 2)
SELECT conv_id,
       CASE WHEN s0 >= s1 THEN t0 ELSE t1 END AS chosen_turn, CASE WHEN s0 >= s1 THEN t1 ELSE t0 END AS rejected_turn,
       greatest(s0, s1) AS chosen_score, least(s0, s1) AS rejected_score
FROM two
""")
def label_online(spark, sf):
    conv = _conv(spark, sf)
    cands = D.first_candidates(conv, 2).withColumn("score", D.text_score("completion"))
    two = P.pair_samples(cands, ["conv_id"], "cand_idx", ["turn", "score"])
    lab = P.label_pairs(two, tie="first", unscored="raise", first="turn_0", second="turn_1",
                        first_score="score_0", second_score="score_1")
    return lab.select("conv_id", F.col("chosen").alias("chosen_turn"), F.col("rejected").alias("rejected_turn"),
                      "chosen_score", "rejected_score")


# -- R4 + F4 + T12: generations (turns and whole documents) over the token budget lose their EOS and
#    get score -1
_GENERATIONS = """SELECT 'turn' AS source, conv_id, turn, text FROM conversations WHERE role = 'assistant'
                  UNION ALL SELECT 'document', doc_id, -1, text FROM documents"""


@register("eos_penalty", f"""
WITH g AS ({_GENERATIONS}), n AS (SELECT *, len({sql_tokens('text')}) AS n FROM g)
SELECT source, conv_id, turn,
       CASE WHEN n <= {GEN_BUDGET} THEN {sql_text_score('text')} ELSE -1.0 END AS score,
       n <= {GEN_BUDGET} AS has_eos, least(n, {GEN_BUDGET}) + CASE WHEN n <= {GEN_BUDGET} THEN 1 ELSE 0 END AS kept
FROM n
""")
def eos_penalty(spark, sf):
    asst = _conv(spark, sf).filter(F.col("role") == "assistant").select(F.lit("turn").alias("source"), "conv_id", "turn", "text")
    docs = table(spark, sf, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("conv_id"),
                                                F.lit(-1).cast("bigint").alias("turn"), "text")
    eos, pad = SPECIALS[EOS], SPECIALS[PAD]
    gen = asst.unionByName(docs).withColumn("_t", token_list("text"))
    gen = gen.withColumn("gen", F.when(F.size("_t") <= GEN_BUDGET, F.array_append("_t", F.lit(eos)))
                         .otherwise(F.slice("_t", 1, GEN_BUDGET)))
    cut = gen.withColumn("cut", truncate_after("gen", eos, pad))
    return cut.select(
        "source", "conv_id", "turn",
        P.penalise_unterminated(D.text_score("text"), has_token("gen", eos)).alias("score"),
        has_token("gen", eos).alias("has_eos"),
        F.size(F.filter("cut", lambda x: x != F.lit(pad))).cast("bigint").alias("kept"))


# -- R2: implicit reward beta * (policy log-prob - reference log-prob) per candidate
_ASST = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"


@register("implicit_reward", f"""
WITH {sql_ngram_model('pol', _ASST)},
{sql_ngram_model('ref', 'SELECT text FROM documents')},
{sql_ngram_score('pi', 'pol', _ASST, ['conv_id', 'turn'], out='pi')},
{sql_ngram_score('rho', 'ref', _ASST, ['conv_id', 'turn'], out='rho')}
SELECT conv_id, turn, {sql_r(f'{BETA} * (pi - rho)')} AS reward FROM pi JOIN rho USING (conv_id, turn)
""")
def implicit_reward(spark, sf):
    asst = _conv(spark, sf).filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    c = L.ngram_logps(asst, ["conv_id", "turn"], "text", fit_models(spark, sf, ("pi", "rho")))
    return c.select("conv_id", "turn", F.round(P.implicit_reward("pi", "rho", BETA), 6).alias("reward"))

