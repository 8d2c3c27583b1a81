"""Queries for model fitting (G1, G2) and batch plug-ins."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.functions.text import md5_bits, rstrip_all
from prefengine.operators import fit as G
from prefengine.operators import order as O
from prefengine.operators import udf as U
from prefengine.operators.pairs import flatten_candidates
from prefengine.operators.policy import dot
from prefengine.operators.tokens import encode, token_list
from prefengine.plans.registry import register, sql_md5_bits, sql_r, sql_tokens, table
from prefengine.session import materialize
from prefengine.sources import driver_tables as D

DIM = 64
THETA = [0.01 * ((i % 7) - 3) for i in range(DIM)]
BETA = 0.1
GOOD_LABEL = 5
SAMPLES = 4


def embedding_pairs(spark, sf) -> DataFrame:
    """Every vector with label >= 5 (chosen) against one with label < 5 (rejected): the n-th good one
    meets the bad one of rank n modulo their number, ranks by md5."""
    e = table(spark, sf, "embeddings")
    narrow = e.select("vec_id", (F.col("label") >= GOOD_LABEL).alias("good"), F.md5(F.col("vec_id").cast("string")).alias("_k"))
    r = O.global_index(narrow, ["_k", "vec_id"], partition_by=["good"], name="rank")
    n_bad = e.filter(F.col("label") < GOOD_LABEL).count()
    g = r.filter("good").select((F.col("rank") % max(1, n_bad)).alias("rank"), F.col("vec_id").alias("chosen_id"))
    b = r.filter(~F.col("good")).select("rank", F.col("vec_id").alias("rejected_id"))
    ph = e.select("vec_id", "embedding")
    return (g.join(b, "rank")
            .join(ph.toDF("chosen_id", "chosen_phi"), "chosen_id")
            .join(ph.toDF("rejected_id", "rejected_phi"), "rejected_id"))


_THETA_SQL = "([" + ", ".join(repr(t) for t in THETA) + "]::DOUBLE[])"
_PAIRS_SQL = f"""
rk AS (SELECT vec_id, label >= {GOOD_LABEL} AS good,
              row_number() OVER (PARTITION BY label >= {GOOD_LABEL} ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS rank
       FROM embeddings),
pr AS (SELECT g.vec_id AS chosen_id, b.vec_id AS rejected_id FROM rk g JOIN rk b
       ON g.rank % (SELECT count(*) FROM rk WHERE NOT good) = b.rank AND g.good AND NOT b.good),
pv AS (SELECT p.*, c.embedding AS ce, r.embedding AS re FROM pr p JOIN embeddings c ON c.vec_id = p.chosen_id
       JOIN embeddings r ON r.vec_id = p.rejected_id),
hh AS (SELECT *, list_reduce(list_transform(ce, lambda x, i: x::DOUBLE * {_THETA_SQL}[i]), lambda a, b: a + b)
                 - list_reduce(list_transform(re, lambda x, i: x::DOUBLE * {_THETA_SQL}[i]), lambda a, b: a + b) AS h
       FROM pv)"""


# -- G2: one full-batch gradient pass of the DPO and IPO objectives for a log-linear policy
@register("gradient_pass", f"""
WITH {_PAIRS_SQL},
cf AS (SELECT *, -{BETA} / (1.0 + exp({BETA} * h)) AS c_dpo, 2.0 * (h - 1.0 / (2.0 * {BETA})) AS c_ipo FROM hh),
n AS (SELECT count(*) AS n FROM pr)
SELECT d.dim::INT AS dim,
       round(sum(c_dpo * (ce[d.dim + 1]::DOUBLE - re[d.dim + 1]::DOUBLE)) / (SELECT n FROM n), 8) + 0.0 AS grad_dpo,
       round(sum(c_ipo * (ce[d.dim + 1]::DOUBLE - re[d.dim + 1]::DOUBLE)) / (SELECT n FROM n), 8) + 0.0 AS grad_ipo
FROM cf, range(0, {DIM}) d(dim) GROUP BY d.dim
""")
def gradient_pass(spark, sf):
    pairs = materialize(embedding_pairs(spark, sf), "pairs")
    dpo = G.preference_gradient(pairs, THETA, "dpo", BETA).withColumnRenamed("grad", "grad_dpo")
    ipo = G.preference_gradient(pairs, THETA, "ipo", BETA).withColumnRenamed("grad", "grad_ipo")
    return dpo.join(ipo, "dim").select("dim", F.round("grad_dpo", 8).alias("grad_dpo"),
                                       F.round("grad_ipo", 8).alias("grad_ipo"))


# -- G1: pairwise reward fit by Newton steps on three quarters of the pairs; weights, and the share of the held-out pairs that the
#    fit orders rightly.  The optimum is unique, so the SQL side may come to it by plain gradient steps
REG, HELD = 0.01, 4
SQL_STEPS, SQL_RATE = 60, 25.0


@register("reward_fit", f"""
WITH RECURSIVE {_PAIRS_SQL.replace(chr(10) + 'hh AS', chr(10) + 'unused AS')},
held AS (SELECT *, {sql_md5_bits('chosen_id::VARCHAR')} % {HELD} = 0 AS held_out FROM pv),
df AS MATERIALIZED (SELECT chosen_id, i, (ce[i]::DOUBLE - re[i]::DOUBLE) AS d FROM held, range(1, {DIM + 1}) t(i) WHERE NOT held_out),
n AS (SELECT count(*) AS n FROM held WHERE NOT held_out),
fit AS (
  SELECT 0 AS step, list_transform(range({DIM}), lambda x: 0.0::DOUBLE) AS w
  UNION ALL
  SELECT step + 1, list(new ORDER BY i) FROM (
    SELECT q.step, x.i, any_value(q.w)[x.i] - {SQL_RATE} * (-sum(q.miss * x.d) / (SELECT n FROM n) + {REG} * any_value(q.w)[x.i]) AS new
    FROM (SELECT f.step, f.w, y.chosen_id, 1.0 / (1.0 + exp(sum(f.w[y.i] * y.d))) AS miss FROM fit f, df y GROUP BY f.step, f.w, y.chosen_id) q
    JOIN df x ON x.chosen_id = q.chosen_id GROUP BY q.step, x.i) GROUP BY step HAVING step < {SQL_STEPS}),
w AS (SELECT w FROM fit ORDER BY step DESC LIMIT 1),
ok AS (SELECT count(*) AS n_held_out, avg((list_inner_product(ce::DOUBLE[], w) > list_inner_product(re::DOUBLE[], w))::INT) AS accuracy FROM held, w WHERE held_out)
SELECT d.dim::INT AS dim, {sql_r('w[d.dim + 1]', 5)} AS weight, n AS n_pairs, n_held_out, {sql_r('accuracy')} AS accuracy FROM w, n, ok, range(0, {DIM}) d(dim)
""")
def reward_fit(spark, sf):
    pairs = materialize(embedding_pairs(spark, sf).withColumn("held_out", md5_bits("chosen_id") % HELD == 0), "pairs")
    fitted = pairs.filter(~F.col("held_out"))
    w = G.fit_reward_newton(fitted, DIM, REG)
    right = (dot(F.col("chosen_phi"), w) > dot(F.col("rejected_phi"), w)).cast("double")
    held = F.col("held_out")
    out = pairs.agg(F.count(F.when(~held, 1)).alias("n_pairs"), F.count(F.when(held, 1)).alias("n_held_out"), F.round(F.avg(F.when(held, right)), 6).alias("accuracy"))
    return out.select(F.posexplode(F.array(*[F.lit(round(x, 5) + 0.0) for x in w])).alias("dim", "weight"), "n_pairs", "n_held_out", "accuracy")


# -- U1: batch scorer plug-in (a deterministic stand-in judge, built once per task)
def make_text_scorer():
    """Share of the most frequent character of a text, in thousandths: no built-in expression has it."""
    def score(texts: pd.Series) -> pd.Series:
        chars = texts.fillna("").map(list).explode().dropna()
        counts = chars.groupby([chars.index, chars]).size().groupby(level=0).max().reindex(texts.index, fill_value=0)
        return (counts * 1000 // texts.str.len().clip(lower=1)).astype("float64")
    return score


@register("udf_score", """
WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, ch, count(*) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch FROM t) WHERE ch <> '' GROUP BY ALL),
m AS (SELECT conv_id, turn, max(n) AS n FROM c GROUP BY ALL)
SELECT t.conv_id, t.turn, (coalesce(m.n, 0) * 1000 // greatest(length(t.text), 1))::DOUBLE AS score FROM t LEFT JOIN m USING (conv_id, turn)
""")
def udf_score(spark, sf):
    asst = table(spark, sf, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn", "text")
    return U.score_with(asst, make_text_scorer, "text").select("conv_id", "turn", "score")


# -- U2: batch sampler plug-in: n completions per prompt (word rotations of the whole prompt)
def make_rotation_sampler():
    def sample(prompts: pd.Series, n: int) -> pd.Series:
        def one(p: str) -> list[str]:
            w = p.split()
            return [" ".join(w[k:] + w[:k]) + "\n" for k in range(n)]
        return prompts.map(one)
    return sample


@register("udf_generate", f"""
WITH sft AS (SELECT u.conv_id, u.turn, list_filter(string_split_regex(u.text, '\\s+'), lambda x: x <> '') AS w
             FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
             WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, k AS cand_idx, array_to_string(list_concat(list_slice(w, k + 1, len(w)), list_slice(w, 1, k)), ' ') AS completion
FROM sft, range(0, {SAMPLES}) r(k)
""")
def udf_generate(spark, sf):
    sft = D.sft_examples(table(spark, sf, "conversations")).select("conv_id", "turn", "prompt")
    gen = U.generate_with(sft, make_rotation_sampler, "prompt", SAMPLES)
    gen = gen.withColumn("completion", rstrip_all("completion")).drop("prompt")
    return flatten_candidates(gen).select("conv_id", "turn", "cand_idx", "completion")


# -- U3: tokenizer plug-in: hashed word ids per batch (crc32 modulo 2^20)
def hash_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [zlib.crc32(w.encode()) % HASHED_IDS for w in t.split()])


HASHED_IDS = 1 << 20


@register("udf_encode", f"""
WITH w AS (SELECT conv_id, turn, {sql_tokens('text')} AS w FROM conversations)
SELECT conv_id, turn, array_to_string(w, ' ') AS words, len(w)::BIGINT AS n_ids FROM w
""")
def udf_encode(spark, sf):
    """The plug-in's ids, looked up again: ids of one turn must stand for its words one to one."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(token_list("text"), " ").alias("words"))
    enc = encode(conv, ["conv_id", "turn"], "words", out="ids", tokenizer=hash_words)
    built_in = F.transform(F.split("words", " "), lambda w: F.pmod(F.crc32(w), F.lit(HASHED_IDS)).cast("int"))
    same = F.when(F.col("words") == "", F.size("ids") == 0).otherwise(F.col("ids") == built_in)
    return enc.select("conv_id", "turn", F.when(same, F.col("words")).alias("words"), F.size("ids").cast("bigint").alias("n_ids"))
