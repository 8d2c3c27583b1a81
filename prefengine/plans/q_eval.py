"""Queries for sweep / checkpoint evaluation (V1-V5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.operators import evaluate as V
from prefengine.operators import logprob as L
from prefengine.functions.math import fixed_point_mean
from prefengine.plans.registry import register, sql_fixed_mean, sql_ngram_model, sql_ngram_score, sql_r, table

BETAS = ["0.01", "0.05", "0.1"]
SEEDS = ["0", "1", "2"]
STEP_EVENTS = 1000
CHECKPOINTS = [1, 2, 3]
BETA = 0.1


def _sweep_rows(spark, sf) -> DataFrame:
    """Sweep results from events: beta by user_id % 3, seed by event_id % 3, step by
    event_id / 1000; run key 'beta<b>_seed<s>'; prompt = user_id; score = round(value / 5)."""
    ev = table(spark, sf, "events")
    beta = F.element_at(F.array(*[F.lit(b) for b in BETAS]), (F.col("user_id") % 3 + 1).cast("int"))
    return ev.select(
        beta.alias("beta"), (F.col("event_id") % 3).cast("string").alias("seed"),
        (F.col("event_id") / STEP_EVENTS).cast("bigint").alias("step"),
        F.col("user_id").alias("prompt_id"), F.round(F.col("value") / 5.0).alias("score"),
        "event_type", "value").withColumn("run_key", V.run_key("beta%s_seed%s", "beta", "seed"))


_SWEEP_SQL = f"""
sw AS (SELECT ['{"', '".join(BETAS)}'][user_id % 3 + 1] AS beta, (event_id % 3)::VARCHAR AS seed,
              (event_id // {STEP_EVENTS})::BIGINT AS step, user_id AS prompt_id, round(value / 5.0) AS score,
              event_type, value FROM events),
sk AS (SELECT *, 'beta' || beta || '_seed' || seed AS run_key FROM sw)"""


# -- V1: sweep coverage: grid of beta x seed x step, left-joined to result rows
@register("sweep_coverage", f"""
WITH {_SWEEP_SQL},
res AS (SELECT run_key, step, count(*) AS n FROM sk GROUP BY ALL),
grid AS (SELECT 'beta' || b || '_seed' || s AS run_key, st AS step
         FROM unnest(['{"', '".join(BETAS)}']) t1(b), unnest(['{"', '".join(SEEDS)}']) t2(s),
              range(0, (SELECT max(event_id) // {STEP_EVENTS} FROM events) + 1) t3(st))
SELECT g.run_key, g.step::BIGINT AS step, coalesce(r.n, 0)::BIGINT AS n_results,
       CASE WHEN coalesce(r.n, 0) = 0 THEN 'missing' WHEN r.n = 1 THEN 'ok' ELSE 'duplicate' END AS status
FROM grid g LEFT JOIN res r USING (run_key, step)
""")
def sweep_coverage(spark, sf):
    rows = _sweep_rows(spark, sf)
    max_step = table(spark, sf, "events").agg((F.max("event_id") / STEP_EVENTS).cast("bigint")).first()[0]
    grid = V.sweep_grid(spark, {"beta": BETAS, "seed": SEEDS}, steps=max_step)
    grid = grid.select(V.run_key("beta%s_seed%s", "beta", "seed").alias("run_key"), "step")
    return V.sweep_coverage(rows, grid, ["run_key", "step"]).select("run_key", "step", "n_results", "status")


_WIN_SQL = f"""
{_SWEEP_SQL},
base AS (SELECT user_id AS prompt_id, round({sql_fixed_mean('value')} / 5.0) AS base FROM events WHERE event_type = 'view' GROUP BY user_id),
cand AS (SELECT run_key, step, prompt_id, score FROM sk WHERE event_type <> 'view'),
wr AS (SELECT run_key, step, sum(CASE WHEN score > base THEN 1 ELSE 0 END)::BIGINT AS wins,
              sum(CASE WHEN score = base THEN 1 ELSE 0 END)::BIGINT AS ties,
              sum(CASE WHEN score < base THEN 1 ELSE 0 END)::BIGINT AS losses, count(*) AS n
       FROM cand JOIN base USING (prompt_id) GROUP BY ROLLUP (run_key, step))"""


def _win_rates(spark, sf, rollup=True):
    rows = _sweep_rows(spark, sf)
    base = (table(spark, sf, "events").filter(F.col("event_type") == "view").groupBy("user_id")
            .agg(F.round(fixed_point_mean("value") / 5.0).alias("score")).withColumnRenamed("user_id", "prompt_id"))
    cand = rows.filter(F.col("event_type") != "view").select("run_key", "step", "prompt_id", "score")
    return V.win_rate(cand, base, ["prompt_id"], ["run_key", "step"], rollup=rollup)


# -- V2: judge win rate against the baseline per run and checkpoint, with rollup totals
@register("win_rate", f"""
WITH {_WIN_SQL}
SELECT coalesce(run_key, 'ALL') AS run_key, coalesce(step, -1)::BIGINT AS step, wins, ties, losses, n,
       {sql_r('(wins + ties / 2.0) / n')} AS win_rate FROM wr
""")
def win_rate(spark, sf):
    out = _win_rates(spark, sf)
    # rollup totals are labelled: run 'ALL' / step -1 (no NULL keys in the result)
    return out.select(F.coalesce("run_key", F.lit("ALL")).alias("run_key"),
                      F.coalesce("step", F.lit(-1).cast("bigint")).alias("step"),
                      "wins", "ties", "losses", "n", F.round("win_rate", 6).alias("win_rate"))


# -- V5: best checkpoint per run (highest win rate, earliest step on ties)
@register("best_checkpoint", f"""
WITH {_WIN_SQL},
r AS (SELECT run_key, step, (wins + ties / 2.0) / n AS win_rate FROM wr WHERE run_key IS NOT NULL AND step IS NOT NULL)
SELECT run_key, step, {sql_r('win_rate')} AS win_rate FROM r
QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY win_rate DESC, step) = 1
""")
def best_checkpoint(spark, sf):
    wr = _win_rates(spark, sf, rollup=False)
    best = V.best_checkpoint(wr, "run_key", "step", "win_rate")
    return best.select("run_key", "step", F.round("win_rate", 6).alias("win_rate"))


# -- V5: onset of over-optimisation: win rate (V2) against the KL of the checkpoint (mean value of the views of the run at the
#    step, a tenth) per run; two lines by prefix sums
_LINE = "CASE WHEN {xx} > 1e-12 THEN {a} ELSE {b} END"


def _segment(n: str, s: str) -> tuple[str, str]:
    t = {k: s.format(k) for k in ("x", "y", "xx", "xy", "yy")}
    xx, xy, yy = (f"({t[a]} - {t[b]} * {t[c]} / {n})" for a, b, c in (("xx", "x", "x"), ("xy", "x", "y"), ("yy", "y", "y")))
    return _LINE.format(xx=xx, a=f"{xy} / {xx}", b="0.0"), _LINE.format(xx=xx, a=f"{yy} - {xy} * {xy} / {xx}", b=yy)


_BEFORE, _ERR_L = _segment("k", "l_{}")
_AFTER, _ERR_R = _segment("(n - k)", "(t_{0} - l_{0})")
_POINTS_SQL = f"""
{_WIN_SQL},
klr AS (SELECT run_key, step, {sql_fixed_mean('value')} / 10.0 AS kl FROM sk WHERE event_type = 'view' GROUP BY ALL),
pt AS (SELECT run_key, step, kl, (wins + ties / 2.0) / n AS reward FROM wr JOIN klr USING (run_key, step))"""


@register("overoptimisation_onset", f"""
WITH {_POINTS_SQL},
c AS (SELECT *, kl - avg(kl) OVER w AS x, reward - avg(reward) OVER w AS y FROM pt WINDOW w AS (PARTITION BY run_key)),
s AS (SELECT *, row_number() OVER o AS k, count(*) OVER w AS n,
      {', '.join(f'sum({e}) OVER (PARTITION BY run_key ORDER BY kl, step ROWS UNBOUNDED PRECEDING) AS l_{a}, sum({e}) OVER w AS t_{a}' for a, e in (('x', 'x'), ('y', 'y'), ('xx', 'x * x'), ('xy', 'x * y'), ('yy', 'y * y')))}
      FROM c WINDOW w AS (PARTITION BY run_key), o AS (PARTITION BY run_key ORDER BY kl, step)),
e AS (SELECT *, CASE WHEN k >= 2 AND k <= n - 2 THEN round({_ERR_L} + {_ERR_R}, 9) END AS err, CASE WHEN k >= 2 AND k <= n - 2 THEN round({_BEFORE}, 9) END AS b,
      CASE WHEN k >= 2 AND k <= n - 2 THEN round({_AFTER}, 9) END AS a FROM s),
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY err NULLS LAST, k) = 1),
peak AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY reward DESC, k) = 1)
SELECT run_key, n AS checkpoints, p.step AS peak_step, {sql_r('p.kl')} AS peak_kl, {sql_r('p.reward')} AS peak_reward,
       CASE WHEN b.b > 0 AND b.a < 0 THEN b.step END AS onset_step, CASE WHEN b.b > 0 AND b.a < 0 THEN {sql_r('b.kl')} END AS onset_kl,
       CASE WHEN b.b > 0 AND b.a < 0 THEN {sql_r('b.b')} END AS slope_before, CASE WHEN b.b > 0 AND b.a < 0 THEN {sql_r('b.a')} END AS slope_after
FROM (SELECT run_key, step, kl, reward FROM peak) p JOIN best b USING (run_key)
""")
def overoptimisation_onset(spark, sf):
    kl = (_sweep_rows(spark, sf).filter(F.col("event_type") == "view").groupBy("run_key", "step")
          .agg((fixed_point_mean("value") / 10.0).alias("kl")))
    points = _win_rates(spark, sf, rollup=False).select("run_key", "step", "win_rate").join(kl, ["run_key", "step"])
    out = V.overoptimisation_onset(points, "run_key", "step", "kl", "win_rate")
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return out.select("run_key", "checkpoints", "peak_step", r("peak_kl"), r("peak_reward"), "onset_step", r("onset_kl"), r("slope_before"), r("slope_after"))


# ------------------------------------------------------------------ checkpoints = policies fitted on growing data
_ASST = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"


def _checkpoint_scores(spark, sf) -> DataFrame:
    """Checkpoint s: bigram policy fitted on assistant turns with conv_id % 3 < s; every
    assistant turn scored under all checkpoints and the reference (documents) model in one
    tokenising pass, then unpivoted to one row per (turn, checkpoint)."""
    conv = table(spark, sf, "conversations")
    asst = conv.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    key = ["conv_id", "turn"]
    nested = {f"pi{s}": F.col("conv_id") % 3 < s for s in CHECKPOINTS}  # one pass counts all checkpoints
    models = L.fit_ngrams([(table(spark, sf, "documents").select("text"), {"rho": F.lit(True)}), (asst, nested)], "text")
    lp = L.ngram_logps(asst, key, "text", models, with_length="n_tokens")
    steps = F.explode(F.array(*[F.struct(F.lit(s).cast("bigint").alias("step"), F.col(f"pi{s}").alias("pi"))
                                for s in CHECKPOINTS])).alias("_s")
    return lp.select(*key, "n_tokens", "rho", steps).select(*key, "n_tokens", "rho", "_s.step", "_s.pi")


def _checkpoint_sql() -> str:
    parts = [sql_ngram_model("ref", "SELECT text FROM documents"),
             sql_ngram_score("rho", "ref", _ASST, ["conv_id", "turn"], out="rho")]
    unions = []
    for s in CHECKPOINTS:
        parts.append(sql_ngram_model(f"p{s}", f"SELECT text FROM conversations WHERE role = 'assistant' AND conv_id % 3 < {s}"))
        parts.append(sql_ngram_score(f"s{s}", f"p{s}", _ASST, ["conv_id", "turn"], out="pi", length="n_tokens"))
        unions.append(f"SELECT conv_id, turn, pi, n_tokens, {s}::BIGINT AS step FROM s{s}")
    parts.append(f"ck AS (SELECT u.*, rho.rho FROM ({' UNION ALL '.join(unions)}) u JOIN rho USING (conv_id, turn))")
    return ",\n".join(parts)


# -- V3: KL to the reference per checkpoint
@register("kl_by_checkpoint", f"""
WITH {_checkpoint_sql()}
SELECT step, {sql_r('avg(pi - rho)')} AS kl, count(*) AS n FROM ck GROUP BY step
""")
def kl_by_checkpoint(spark, sf):
    out = V.kl_by_checkpoint(_checkpoint_scores(spark, sf), "step", "pi", "rho")
    return out.select("step", F.round("kl", 6).alias("kl"), "n")


# -- V4: length bias per checkpoint (correlation of length with implicit reward)
@register("length_bias", f"""
WITH {_checkpoint_sql()}
SELECT step, {sql_r(f'corr(n_tokens::DOUBLE, {BETA} * (pi - rho))')} AS corr_len_reward,
       {sql_r(f'avg({BETA} * (pi - rho))')} AS mean_reward, {sql_r('avg(n_tokens)')} AS mean_length
FROM ck GROUP BY step
""")
def length_bias(spark, sf):
    c = _checkpoint_scores(spark, sf).withColumn("reward", F.lit(BETA) * (F.col("pi") - F.col("rho")))
    out = V.length_bias(c, "step", "n_tokens", "reward")
    return out.select("step", *[F.round(x, 6).alias(x) for x in ("corr_len_reward", "mean_reward", "mean_length")])
