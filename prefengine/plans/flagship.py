"""Flagship: conversations -> candidate sets -> first K pairs -> judge labels -> n-gram
log-probs under policy and reference -> DPO loss -> metrics per candidate-set size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefengine.operators.metrics import pair_metrics
from prefengine.operators.objectives import objective
from prefengine.plans.q_logprob import train_pairs
from prefengine.plans.registry import register, sql_ngram_model, sql_ngram_score, sql_r, sql_softplus, sql_text_score

K_PAIRS = 4
BETA = 0.1


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = objective(train_pairs(spark, sf_dir, K_PAIRS, models=("pi", "rho")), "dpo", beta=BETA)
    m = pair_metrics(pairs, BETA)
    return (m.groupBy("n_candidates")
            .agg(F.count(F.lit(1)).alias("pairs"),
                 F.round(F.avg("loss"), 6).alias("mean_loss"),
                 F.round(F.avg("margins"), 6).alias("mean_margin"),
                 F.round(F.avg("accuracy"), 6).alias("accuracy"),
                 F.round(F.avg("score_margin"), 6).alias("mean_score_margin")))


def _pairs_sql(k: int = K_PAIRS) -> str:
    """CTE chain ending in ``lab``: labelled pairs with policy/reference log-probs."""
    asst = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"
    return f"""
{sql_ngram_model('pol', asst)},
{sql_ngram_model('ref', 'SELECT text FROM documents')},
{sql_ngram_score('pi', 'pol', asst, ['conv_id', 'turn'], out='pi')},
{sql_ngram_score('rho', 'ref', asst, ['conv_id', 'turn'], out='rho')},
cand AS (SELECT a.conv_id, a.turn, {sql_text_score('a.text')} AS score, pi.pi, rho.rho
         FROM ({asst}) a JOIN pi USING (conv_id, turn) JOIN rho USING (conv_id, turn)),
firsts AS (SELECT conv_id, min(turn) AS first_turn, count(*) AS n_candidates
           FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
prompted AS (SELECT f.conv_id, f.n_candidates FROM firsts f
             WHERE EXISTS (SELECT 1 FROM conversations u WHERE u.conv_id = f.conv_id
                           AND u.role = 'user' AND u.turn < f.first_turn)),
ranked AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r
           FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT x.conv_id, p.n_candidates, x.turn AS first_turn, y.turn AS second_turn,
                 row_number() OVER (PARTITION BY x.conv_id ORDER BY x.r, y.r) - 1 AS pair_idx
          FROM ranked x JOIN ranked y ON x.conv_id = y.conv_id AND x.r < y.r
          JOIN prompted p ON p.conv_id = x.conv_id),
joined AS (SELECT p.*, a.score AS sa, b.score AS sb, a.pi AS pi_a, b.pi AS pi_b, a.rho AS rho_a, b.rho AS rho_b
           FROM pairs p JOIN cand a ON a.conv_id = p.conv_id AND a.turn = p.first_turn
           JOIN cand b ON b.conv_id = p.conv_id AND b.turn = p.second_turn
           WHERE p.pair_idx < {k}),
lab AS (SELECT conv_id, n_candidates, pair_idx,
               CASE WHEN sa > sb THEN first_turn ELSE second_turn END AS chosen_turn,
               CASE WHEN sa > sb THEN second_turn ELSE first_turn END AS rejected_turn,
               greatest(sa, sb) AS chosen_score, least(sa, sb) AS rejected_score,
               CASE WHEN sa > sb THEN pi_a ELSE pi_b END AS chosen_logps,
               CASE WHEN sa > sb THEN pi_b ELSE pi_a END AS rejected_logps,
               CASE WHEN sa > sb THEN rho_a ELSE rho_b END AS ref_chosen_logps,
               CASE WHEN sa > sb THEN rho_b ELSE rho_a END AS ref_rejected_logps
        FROM joined WHERE NOT isnan(sa) AND NOT isnan(sb))"""


H_SQL = "((chosen_logps - rejected_logps) - (ref_chosen_logps - ref_rejected_logps))"

FLAGSHIP_SQL = f"""
WITH {_pairs_sql()},
m AS (SELECT *, {sql_softplus(f'-{BETA} * {H_SQL}')} AS loss,
             {BETA} * (chosen_logps - ref_chosen_logps) AS cr, {BETA} * (rejected_logps - ref_rejected_logps) AS rr
      FROM lab)
SELECT n_candidates, count(*) AS pairs,
       {sql_r('avg(loss)')} AS mean_loss, {sql_r('avg(cr - rr)')} AS mean_margin,
       {sql_r('avg(CASE WHEN cr > rr THEN 1.0 ELSE 0.0 END)')} AS accuracy,
       {sql_r('avg(chosen_score - rejected_score)')} AS mean_score_margin
FROM m GROUP BY n_candidates
"""

register("flagship_dpo_by_set_size", FLAGSHIP_SQL)(flagship)
