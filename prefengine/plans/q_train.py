"""Queries for objectives (J1-J7) and metrics (M1-M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefengine.functions import arrays as A
from prefengine.functions.text import truncation_mode
from prefengine.operators import metrics as MT
from prefengine.operators import order as O
from prefengine.operators.objectives import objective
from prefengine.operators.tokens import EOS, token_list
from prefengine.plans.q_logprob import MODELS, TRAIN_PAIRS_SQL, train_pairs
from prefengine.plans.q_tokens import MAX_LEN, MAX_PROMPT
from prefengine.plans.registry import register, sql_fixed_mean, sql_r, sql_softplus, sql_tokens, table
from prefengine.sources import driver_tables as D

BETA, EPS, ETA, ALPHA = 0.1, 0.25, 0.005, 0.01
H = "((chosen_logps - rejected_logps) - (ref_chosen_logps - ref_rejected_logps))"
IPO = f"(({H} - 1.0 / (2.0 * {BETA})) * ({H} - 1.0 / (2.0 * {BETA})))"
DPO = sql_softplus(f"(-{BETA} * {H})")
W = f"exp(least(chosen_logps - data_chosen_logps + rejected_logps - data_rejected_logps, {2 * EPS}))"


def _loss_query(kind: str, models=("pi", "rho"), **kw):
    def q(spark, sf):
        out = objective(train_pairs(spark, sf, models=models), kind, beta=BETA, eps=EPS, eta=ETA, alpha=ALPHA, **kw)
        return out.select("conv_id", "pair_idx", F.round("h", 6).alias("h"), F.round("weight", 6).alias("weight"),
                          F.round("loss", 6).alias("loss"))
    return q


def _loss_sql(h: str, weight: str, loss: str) -> str:
    return f"""
WITH {TRAIN_PAIRS_SQL}
SELECT conv_id, pair_idx, {sql_r(h) if h != 'NULL' else 'NULL::DOUBLE'} AS h, {sql_r(weight)} AS weight,
       {sql_r(loss)} AS loss FROM tp
"""


# -- J1 DPO, J2 IPO, J3 IS-weighted (IPO and sigmoid bases), J4 RPO, J5 length, J6 reward, J7 SFT
register("loss_dpo", _loss_sql(H, "1.0", DPO))(_loss_query("dpo"))
register("loss_ipo", _loss_sql(H, "1.0", IPO))(_loss_query("ipo"))
register("loss_is", _loss_sql(H, W, f"{W} * {IPO}"))(_loss_query("is", models=MODELS))
register("loss_is_sigmoid", _loss_sql(H, W, f"{W} * {DPO}"))(_loss_query("is", models=MODELS, base="sigmoid"))
register("loss_rpo", _loss_sql(H, "1.0", f"{DPO} - {BETA} * {ETA} * chosen_logps"))(_loss_query("rpo"))
register("loss_reward", _loss_sql("(chosen_score - rejected_score)", "1.0",
                                  sql_softplus("(-(chosen_score - rejected_score))")))(_loss_query("reward", models=()))


# -- J5: lengths are scored tokens (T13) of the truncated example: the prompt is cut to 512 tokens if
#    the pair is over 640, then the completion to what is left; EOS counts
def _scored_length(prompt: str, n: str):
    ids = lambda c: F.array_repeat(F.lit(EOS + 2), c)
    p, c = ids(F.size(token_list(prompt))), ids(F.col(n).cast("int"))
    p2 = A.truncate_prompt(p, c, MAX_LEN, MAX_PROMPT, truncation_mode(prompt))
    full = A.append_token(A.truncate_completion(p2, c, MAX_LEN), EOS)
    return A.target_length(A.prompt_masked_labels(p2, full)).cast("bigint")


def _scored_sql(n: str) -> str:
    cut = f"(CASE WHEN np + {n} > {MAX_LEN} AND np > {MAX_PROMPT} THEN {MAX_PROMPT} ELSE np END)"
    return (f"(CASE WHEN {cut} + {n} > {MAX_LEN} THEN greatest({MAX_LEN} - {cut}, 0) ELSE {n} END + 1"
            f" - CASE WHEN {cut} = 0 THEN 1 ELSE 0 END)")


_LENGTHS = f"({_scored_sql('chosen_length')} - {_scored_sql('rejected_length')})"


@register("loss_length", f"""
WITH {TRAIN_PAIRS_SQL},
pr AS (SELECT f.conv_id, (SELECT arg_max(u.text, u.turn) FROM conversations u WHERE u.conv_id = f.conv_id
                          AND u.role = 'user' AND u.turn < f.first_turn) AS prompt FROM firsts f),
tl AS (SELECT tp.*, len({sql_tokens('pr.prompt')}) AS np FROM tp JOIN pr USING (conv_id))
SELECT conv_id, pair_idx, {sql_r(H)} AS h, {sql_r('1.0')} AS weight,
       {sql_r(sql_softplus(f"(-({BETA} * {H} + {ALPHA} * {_LENGTHS}))"))} AS loss FROM tl
""")
def loss_length(spark, sf):
    tp = train_pairs(spark, sf, models=("pi", "rho"), length=True)
    tp = tp.withColumns({c: _scored_length("prompt", c) for c in ("chosen_length", "rejected_length")})
    out = objective(tp, "length", beta=BETA, eps=EPS, eta=ETA, alpha=ALPHA)
    return out.select("conv_id", "pair_idx", *[F.round(c, 6).alias(c) for c in ("h", "weight", "loss")])


@register("loss_sft", f"""
WITH {TRAIN_PAIRS_SQL}
SELECT conv_id, pair_idx, {sql_r('-chosen_logps')} AS loss_sum, {sql_r('-chosen_logps / chosen_length')} AS loss_mean
FROM tp
""")
def loss_sft(spark, sf):
    tp = train_pairs(spark, sf, models=("pi",), length=True).withColumn("logp_mean", F.try_divide(F.col("chosen_logps"),
                                                                     F.col("chosen_length").cast("double")))
    s = objective(tp, "sft", logp="chosen_logps").select("conv_id", "pair_idx", "logp_mean",
                                                          F.round("loss", 6).alias("loss_sum"))
    m = objective(s, "sft", logp="logp_mean")
    return m.select("conv_id", "pair_idx", "loss_sum", F.round("loss", 6).alias("loss_mean"))


# -- M1 M3: per-pair rewards, margin, accuracy, score margin
@register("pair_metrics", f"""
WITH {TRAIN_PAIRS_SQL}
SELECT conv_id, pair_idx, {sql_r(f'{BETA} * (chosen_logps - ref_chosen_logps)')} AS chosen_rewards,
       {sql_r(f'{BETA} * (rejected_logps - ref_rejected_logps)')} AS rejected_rewards,
       {sql_r(f'{BETA} * (chosen_logps - ref_chosen_logps) - {BETA} * (rejected_logps - ref_rejected_logps)')} AS margins,
       CASE WHEN {BETA} * (chosen_logps - ref_chosen_logps) > {BETA} * (rejected_logps - ref_rejected_logps) THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy,
       {sql_r('chosen_score - rejected_score')} AS score_margin
FROM tp
""")
def pair_metrics(spark, sf):
    m = MT.pair_metrics(train_pairs(spark, sf, models=("pi", "rho")), BETA)
    return m.select("conv_id", "pair_idx", *[F.round(c, 6).alias(c) for c in
                                             ("chosen_rewards", "rejected_rewards", "margins")],
                    "accuracy", F.round("score_margin", 6).alias("score_margin"))


# -- M2 M6: sequence KL estimate and mean completion length per candidate-set size
@register("kl_estimate", f"""
WITH {TRAIN_PAIRS_SQL}
SELECT n_candidates, {sql_r('avg(((chosen_logps - ref_chosen_logps) + (rejected_logps - ref_rejected_logps)) / 2.0)')} AS kl,
       count(*) AS n, {sql_r('avg((chosen_length + rejected_length) / 2.0)')} AS mean_length
FROM tp GROUP BY n_candidates
""")
def kl_estimate(spark, sf):
    tp = train_pairs(spark, sf, models=("pi", "rho"), length=True)
    mean = F.avg((F.col("chosen_length") + F.col("rejected_length")) / 2.0)
    kl = MT.kl_estimate(tp, by=["n_candidates"], mean_length=mean)
    return kl.select("n_candidates", F.round("kl", 6).alias("kl"), "n", F.round("mean_length", 6).alias("mean_length"))


# ------------------------------------------------------------------ metric log (events)
BATCH, ACCUM = 16, 4
_LOG_SQL = f"""
log AS (SELECT user_id % 5 AS run, event_type AS metric, event_id AS idx0, value, ts,
               row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) - 1 AS idx FROM events),
iv AS (SELECT *, idx // {BATCH * ACCUM} AS interval FROM log)"""


def _log_intervals(spark, sf):
    log = D.metric_log(table(spark, sf, "events"))
    return O.assign_batches(log, BATCH * ACCUM, ["idx"], name="interval", partition_by=["run"],
                            index_name="pos")


# -- M4: mean of every metric per logging interval (batch x accumulation examples), per run
@register("interval_means", f"""
WITH {_LOG_SQL}
SELECT run, interval::BIGINT AS interval, count(*) AS examples, {sql_fixed_mean('value')} AS value,
       {sql_fixed_mean("CASE WHEN metric = 'click' THEN value END")} AS click,
       {sql_fixed_mean("CASE WHEN metric = 'purchase' THEN value END")} AS purchase
FROM iv GROUP BY run, interval
""")
def interval_means(spark, sf):
    log = D.metric_log(table(spark, sf, "events")).withColumns({
        "click": F.when(F.col("metric") == "click", F.col("value")),
        "purchase": F.when(F.col("metric") == "purchase", F.col("value"))})
    out = MT.interval_means(log, ["value", "click", "purchase"], BATCH, ACCUM, ["idx"], by=["run"], scale=2)
    return out.select("run", "interval", "examples", "value", "click", "purchase")


# -- M5: throughput per logging interval: examples / wall-clock span
@register("throughput", f"""
WITH {_LOG_SQL}
SELECT run, interval::BIGINT AS interval, count(*) AS examples,
       {sql_r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6')} AS seconds,
       {sql_r('count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0)')} AS examples_per_second
FROM iv GROUP BY run, interval
""")
def throughput(spark, sf):
    iv = _log_intervals(spark, sf)
    out = MT.throughput(iv, "ts", ["run", "interval"])
    return out.select("run", "interval", "examples", F.round("seconds", 6).alias("seconds"),
                      F.round("examples_per_second", 6).alias("examples_per_second"))


# -- M7: running accuracy per run as results arrive (hit = value above 25)
@register("running_accuracy", f"""
SELECT user_id % 5 AS run, event_id,
       {sql_r('avg(CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS running_accuracy,
       count(*) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
FROM events
""")
def running_accuracy(spark, sf):
    ev = table(spark, sf, "events").select((F.col("user_id") % 5).alias("run"), "event_id",
                                           (F.col("value") > 25).alias("hit"))
    out = MT.running_accuracy(ev, "hit", ["event_id"], by=["run"])
    return out.select("run", "event_id", F.round("running_accuracy", 6).alias("running_accuracy"), "seen")


# ------------------------------------------------------------------ batch schedule over SFT examples
SFT_BATCH, SFT_ACCUM, EPOCHS, LR, WARMUP, EVAL_EVERY = 8, 2, 1, 1.0, 3, 20
_SFT_BATCHES_SQL = f"""
sft AS (SELECT u.conv_id, u.turn FROM conversations u JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
nb AS (SELECT count(*) AS n FROM sft),
bt AS (SELECT DISTINCT (row_number() OVER (ORDER BY md5('42:' || conv_id::VARCHAR || ':' || turn::VARCHAR), conv_id, turn) - 1) // {SFT_BATCH} AS batch_id FROM sft)"""


def _sft_batches(spark, sf):
    sft = D.sft_examples(table(spark, sf, "conversations")).select("conv_id", "turn")
    b = O.assign_batches(sft.withColumn("_k", O.shuffle_key(42, "conv_id", "turn")), SFT_BATCH,
                         ["_k", "conv_id", "turn"])
    return b.select("batch_id").distinct(), sft.count()


# -- M8: learning rate of every batch (linear warm-up, cosine to 0.1 lr)
@register("batch_lr", f"""
WITH {_SFT_BATCHES_SQL},
st AS (SELECT batch_id, batch_id // {SFT_ACCUM} AS step,
              ((SELECT n FROM nb) // ({SFT_BATCH} * {SFT_ACCUM})) * {EPOCHS} AS total FROM bt)
SELECT batch_id::BIGINT AS batch_id, step::BIGINT AS step,
       {sql_r(f'''{LR} * CASE WHEN step < {WARMUP} THEN step / {float(max(1, WARMUP))}
            ELSE greatest(0.0, (0.5 * (1.0 + cos(pi() * (step - {WARMUP}) / greatest(1, total - {WARMUP})))) * 0.9 + 0.1) END''')} AS lr
FROM st
""")
def batch_lr(spark, sf):
    batches, n = _sft_batches(spark, sf)
    out = MT.with_lr(batches, n, SFT_BATCH, SFT_ACCUM, EPOCHS, LR, WARMUP)
    return out.select("batch_id", "step", F.round("lr", 6).alias("lr"))


# -- M9: checkpoint steps (example counter a positive multiple of eval_every, tested before the batch)
@register("checkpoint_steps", f"""
WITH {_SFT_BATCHES_SQL}
SELECT batch_id::BIGINT AS batch_id, (batch_id * {SFT_BATCH})::BIGINT AS example_counter FROM bt
WHERE (batch_id * {SFT_BATCH}) % {EVAL_EVERY} = 0 AND batch_id * {SFT_BATCH} > 0
""")
def checkpoint_steps(spark, sf):
    batches, _ = _sft_batches(spark, sf)
    return MT.checkpoint_steps(batches, SFT_BATCH, EVAL_EVERY).select("batch_id", "example_counter")
