"""Queries for log-prob operators (L1-L7, T14) and the shared training-pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefengine.functions.arrays import IGNORE_INDEX
from prefengine.functions.math import _token_logps, seq_logp
from prefengine.operators import logprob as L
from prefengine.operators import order as O
from prefengine.operators.pairs import candidate_pairs, label_pairs
from prefengine.operators.tokens import token_list
from prefengine.plans.registry import (ORACLE, register, sql_ngram_model, sql_ngram_score, sql_r, sql_text_score,
                                       table)
from prefengine.sources import driver_tables as D

POS, VOC = 8, 8
TEMP = 0.7
PACK = 4
K_PAIRS = 4


# ------------------------------------------------------------------ logits from embeddings
def _logits(spark, sf) -> DataFrame:
    """64 floats = 8 positions x 8-way vocabulary; labels: the first 1 + vec_id % 3 positions
    are prompt (IGNORE_INDEX), then (7 vec_id + 3 p) mod 8."""
    e = table(spark, sf, "embeddings")
    logits = F.transform(F.sequence(F.lit(0), F.lit(POS - 1)),
                         lambda p: F.slice("embedding", p * VOC + 1, VOC))
    labels = F.transform(F.sequence(F.lit(0), F.lit(POS - 1)), lambda p: F.when(
        p < F.lit(1) + F.col("vec_id") % 3, F.lit(IGNORE_INDEX)).otherwise(
        F.pmod(F.col("vec_id") * 7 + p * 3, F.lit(VOC))).cast("int"))
    return e.select("vec_id", logits.alias("logits"), labels.alias("labels"))


_CELLS_SQL = f"""
cells AS (SELECT vec_id, p, v, embedding[p * {VOC} + v + 1]::DOUBLE AS x
          FROM embeddings, range(0, {POS - 1}) a(p), range(0, {VOC}) b(v)),
lab AS (SELECT vec_id, p, CASE WHEN p + 1 < 1 + vec_id % 3 THEN {IGNORE_INDEX} ELSE (vec_id * 7 + (p + 1) * 3) % {VOC} END AS label
        FROM embeddings, range(0, {POS - 1}) a(p))"""


def _lse_sql(scale: str) -> str:
    return f"""
sc AS (SELECT vec_id, p, v, x / {scale} AS x FROM cells),
mx AS (SELECT vec_id, p, max(x) AS m FROM sc GROUP BY ALL),
lse AS (SELECT s.vec_id, s.p, m.m + ln(sum(exp(s.x - m.m))) AS lse FROM sc s JOIN mx m USING (vec_id, p) GROUP BY s.vec_id, s.p, m.m),
tok AS (SELECT l.vec_id, l.p, CASE WHEN l.label = {IGNORE_INDEX} THEN 0.0 ELSE s.x - lse.lse END AS lp,
               l.label <> {IGNORE_INDEX} AS scored
        FROM lab l JOIN lse USING (vec_id, p) LEFT JOIN sc s ON s.vec_id = l.vec_id AND s.p = l.p AND s.v = l.label)"""


# -- L1 L2 L3: sequence log-prob from logits (sum, mean per scored token, temperature-scaled)
@register("logits_logp", f"""
WITH {_CELLS_SQL},
t1 AS (WITH {_lse_sql('1.0')} SELECT vec_id, sum(lp) AS s, sum(scored::INT) AS n FROM tok GROUP BY vec_id),
t2 AS (WITH {_lse_sql(str(TEMP))} SELECT vec_id, sum(lp) AS s FROM tok GROUP BY vec_id)
SELECT vec_id, {sql_r('t1.s')} AS logp_sum, {sql_r('t1.s / nullif(t1.n, 0)')} AS logp_mean, {sql_r('t2.s')} AS logp_temp
FROM t1 JOIN t2 USING (vec_id)
""")
def logits_logp(spark, sf):
    d = _logits(spark, sf)
    return d.select("vec_id", F.round(seq_logp("logits", "labels"), 6).alias("logp_sum"),
                    F.round(seq_logp("logits", "labels", average=True), 6).alias("logp_mean"),
                    F.round(seq_logp("logits", "labels", temperature=TEMP), 6).alias("logp_temp"))


# -- L1 L2 L3 over a vocabulary in chunks: no cell holds a position's whole logits
CHUNK = 3


def logit_chunks(logits: DataFrame, width: int) -> DataFrame:
    """One row per (vec_id, position, ``width`` ids) with the position's target, the label that follows it."""
    rows = logits.select("vec_id", "labels", F.posexplode("logits").alias("pos", "row")).filter(F.col("pos") < F.size("labels") - 1)
    rows = rows.select("vec_id", "pos", F.get("labels", F.col("pos") + 1).alias("label"), "row", F.explode(F.sequence(F.lit(0), F.size("row") - 1, F.lit(width))).alias("first_id"))
    return rows.select("vec_id", "pos", "label", "first_id", F.slice("row", F.col("first_id") + 1, F.lit(width)).alias("values"))


@register("logits_logp_chunked", ORACLE["logits_logp"])  # the same log-probs as from whole logits
def logits_logp_chunked(spark, sf):
    chunks = logit_chunks(_logits(spark, sf), CHUNK)
    out = L.chunked_logps(chunks, ["vec_id"], out="logp_sum")
    for name, options in (("logp_mean", {"average": True}), ("logp_temp", {"temperature": TEMP})):
        out = out.join(L.chunked_logps(chunks, ["vec_id"], out=name, **options), "vec_id")
    return out.select("vec_id", *[F.round(c, 6).alias(c) for c in ("logp_sum", "logp_mean", "logp_temp")])


# -- L4: per-document log-prob recovered from a packed batch (doc index carried in the mask)
@register("packed_logp", f"""
WITH {_CELLS_SQL}, {_lse_sql('1.0')},
per AS (SELECT vec_id, sum(lp) AS s FROM tok GROUP BY vec_id),
rk AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings)
SELECT (idx // {PACK})::BIGINT AS batch_id, (idx % {PACK} + 1)::INT AS doc, {sql_r('s')} AS logp
FROM per JOIN rk USING (vec_id)
""")
def packed_logp(spark, sf):
    d = _logits(spark, sf)
    per_tok = d.select("vec_id", _token_logps(F.transform("logits", lambda r: F.transform(
        r, lambda v: v.cast("double"))), "labels").alias("lps"))
    b = O.assign_batches(per_tok, PACK, ["vec_id"], key="vec_id").withColumn("ord", F.col("idx") % PACK)
    packed = (b.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("ord", "lps"))).alias("_d"))
              .select("batch_id",
                      F.flatten(F.transform("_d", lambda x: x["lps"])).alias("lps"),
                      F.flatten(F.transform("_d", lambda x, i: F.array_repeat((i + 1).cast("int"),
                                                                              F.size(x["lps"])))).alias("mask")))
    tokens = packed.select("batch_id", F.explode(F.arrays_zip("lps", "mask")).alias("_t")) \
        .select("batch_id", F.col("_t.lps").alias("lp"), F.col("_t.mask").alias("doc"))
    out = L.packed_logp(tokens, ["batch_id"], "doc", "lp")
    return out.select("batch_id", "doc", F.round("logp", 6).alias("logp"))


# ------------------------------------------------------------------ n-gram models and training pairs
_ASST = "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'"
_USER = "SELECT text FROM conversations WHERE role = 'user'"


MODELS = ("pi", "rho", "dat")


def fit_models(spark, sf, names=MODELS) -> L.NgramModels:
    """Only the models asked for: policy (assistant bigrams), reference (document bigrams) and data
    (user bigrams), counted in one pass over the tables they need."""
    conv = table(spark, sf, "conversations").select("text", "role")
    turns = {n: F.col("role") == r for n, r in (("pi", "assistant"), ("dat", "user")) if n in names}
    parts = [(conv.filter(F.col("role").isin("assistant", "user")), turns)] if turns else []
    if "rho" in names:
        parts.append((table(spark, sf, "documents").select("text"), {"rho": F.lit(True)}))
    return L.fit_ngrams(parts, "text")


def candidates(spark, sf, k: int, models=MODELS, length: bool = False) -> DataFrame:
    """The first K + 1 assistant turns of each conversation (E2 with K pairs reads no others) with judge
    score and, as asked for, log-probs and token count."""
    c = D.first_candidates(table(spark, sf, "conversations"), k + 1)
    key = ["conv_id", "turn"]
    out = c.select(*key, D.text_score("completion").alias("score"), F.size(token_list("completion")).cast("bigint").alias("n_tokens"))
    if models:
        out = out.join(L.ngram_logps(c.select(*key, "completion"), key, "completion", fit_models(spark, sf, models)), key)
    return out if length else out.drop("n_tokens")


def pair_rows(spark, sf, k: int = K_PAIRS, models=MODELS, length: bool = False) -> DataFrame:
    """The first K candidate pairs with every value of both sides (x_a, x_b).

    Candidates are gathered as structs that carry all their values (at most K + 1 per conversation),
    so pairs are made in the row and nothing is joined back."""
    conv = table(spark, sf, "conversations")
    c = candidates(spark, sf, k, models, length)
    values = [x for x in c.columns if x != "conv_id"]
    sets = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*values))).alias("cands"))
    prompts = D.candidate_prompts(conv).select("conv_id", "n_candidates", *["prompt"] * length)
    pairs = candidate_pairs(sets.join(prompts, "conv_id"), k, col="cands", first="a", second="b")
    return pairs.select("conv_id", "n_candidates", "pair_idx", *["prompt"] * length,
                        *[F.col(f"{s}.{x}").alias(f"{x}_{s}") for s in ("a", "b") for x in values])


def train_pairs(spark, sf, k: int = K_PAIRS, models=MODELS, length: bool = False) -> DataFrame:
    """Labelled candidate pairs with the columns asked for: log-probs of ``models`` and, with
    ``length``, token counts and prompt."""
    pairs = pair_rows(spark, sf, k, models, length)
    names = {"pi": "logps", "rho": "rl", "dat": "dl", "n_tokens": "length"}
    lab = label_pairs(pairs, tie="second", unscored="raise", first="turn_a", second="turn_b", first_score="score_a",
                      second_score="score_b",
                      carry={new: (f"{x}_a", f"{x}_b") for x, new in names.items() if f"{x}_a" in pairs.columns})
    for old, new in (("chosen", "chosen_turn"), ("rejected", "rejected_turn"), ("chosen_rl", "ref_chosen_logps"),
                     ("rejected_rl", "ref_rejected_logps"), ("chosen_dl", "data_chosen_logps"), ("rejected_dl", "data_rejected_logps")):
        lab = lab.withColumnRenamed(old, new)
    return lab


TRAIN_PAIRS_SQL = f"""
{sql_ngram_model('pol', _ASST)},
{sql_ngram_model('ref', 'SELECT text FROM documents')},
{sql_ngram_model('dat', _USER)},
{sql_ngram_score('pi', 'pol', _ASST, ['conv_id', 'turn'], out='pi', length='n_tokens')},
{sql_ngram_score('rho', 'ref', _ASST, ['conv_id', 'turn'], out='rho')},
{sql_ngram_score('dd', 'dat', _ASST, ['conv_id', 'turn'], out='dat')},
cand AS (SELECT a.conv_id, a.turn, {sql_text_score('a.text')} AS score, pi.pi, pi.n_tokens, rho.rho, dd.dat
         FROM ({_ASST}) a JOIN pi USING (conv_id, turn) JOIN rho USING (conv_id, turn) JOIN dd USING (conv_id, turn)),
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
joined AS (SELECT p.*, a.score AS sa, b.score AS sb, a.pi AS pi_a, b.pi AS pi_b, a.rho AS rho_a, b.rho AS rho_b,
                  a.dat AS dat_a, b.dat AS dat_b, a.n_tokens AS len_a, b.n_tokens AS len_b
           FROM pairs p JOIN cand a ON a.conv_id = p.conv_id AND a.turn = p.first_turn
           JOIN cand b ON b.conv_id = p.conv_id AND b.turn = p.second_turn
           WHERE p.pair_idx < {K_PAIRS}),
tp AS (SELECT conv_id, n_candidates, pair_idx,
              CASE WHEN sa > sb THEN first_turn ELSE second_turn END AS chosen_turn,
              CASE WHEN sa > sb THEN second_turn ELSE first_turn END AS rejected_turn,
              greatest(sa, sb) AS chosen_score, least(sa, sb) AS rejected_score,
              CASE WHEN sa > sb THEN pi_a ELSE pi_b END AS chosen_logps,
              CASE WHEN sa > sb THEN pi_b ELSE pi_a END AS rejected_logps,
              CASE WHEN sa > sb THEN rho_a ELSE rho_b END AS ref_chosen_logps,
              CASE WHEN sa > sb THEN rho_b ELSE rho_a END AS ref_rejected_logps,
              CASE WHEN sa > sb THEN dat_a ELSE dat_b END AS data_chosen_logps,
              CASE WHEN sa > sb THEN dat_b ELSE dat_a END AS data_rejected_logps,
              CASE WHEN sa > sb THEN len_a ELSE len_b END AS chosen_length,
              CASE WHEN sa > sb THEN len_b ELSE len_a END AS rejected_length
       FROM joined WHERE NOT isnan(sa) AND NOT isnan(sb))"""


# -- L7: n-gram log-probs (bigram and trigram, add-k) of every SFT completion
@register("ngram_logp", f"""
WITH {sql_ngram_model('b2', _ASST, 2)},
{sql_ngram_model('b3', _ASST, 3)},
sft AS (SELECT a.conv_id, a.turn, a.text FROM conversations u JOIN conversations a
        ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
{sql_ngram_score('s2', 'b2', 'SELECT * FROM sft', ['conv_id', 'turn'], n=2, out='logp2', length='n_tokens')},
{sql_ngram_score('s3', 'b3', 'SELECT * FROM sft', ['conv_id', 'turn'], n=3, k=0.5, out='logp3')}
SELECT conv_id, turn, {sql_r('logp2')} AS logp2, {sql_r('logp3')} AS logp3, n_tokens
FROM s2 JOIN s3 USING (conv_id, turn)
""")
def ngram_logp(spark, sf):
    conv = table(spark, sf, "conversations")
    asst = conv.filter(F.col("role") == "assistant").select("text")
    sft = D.sft_examples(conv).select("conv_id", F.col("turn") + 1, "completion").toDF("conv_id", "turn", "text")
    m2, m3 = L.fit_ngram(asst, "text", n=2, k=1.0), L.fit_ngram(asst, "text", n=3, k=0.5)
    key = ["conv_id", "turn"]
    s2 = L.ngram_logp(sft, key, "text", m2, out="logp2", with_length="n_tokens")
    s3 = L.ngram_logp(sft, key, "text", m3, out="logp3")
    return s2.join(s3, key).select(*key, F.round("logp2", 6).alias("logp2"), F.round("logp3", 6).alias("logp3"),
                                   "n_tokens")


# -- L5: long (pair, side, log-prob) -> chosen / rejected columns
@register("pivot_sides", f"""
WITH {TRAIN_PAIRS_SQL}
SELECT conv_id, pair_idx, {sql_r('chosen_logps')} AS chosen_logps, {sql_r('rejected_logps')} AS rejected_logps FROM tp
""")
def pivot_sides(spark, sf):
    tp = train_pairs(spark, sf, models=("pi",))
    long = tp.select("conv_id", "pair_idx", F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("chosen_logps").alias("v")),
        F.struct(F.lit("rejected").alias("side"), F.col("rejected_logps").alias("v")))).alias("_s")) \
        .select("conv_id", "pair_idx", "_s.side", "_s.v")
    w = L.pivot_sides(long, ["conv_id", "pair_idx"], "side", "v")
    return w.select("conv_id", "pair_idx", F.round("chosen_logps", 6).alias("chosen_logps"),
                    F.round("rejected_logps", 6).alias("rejected_logps"))


# -- L6 T14: precomputed reference log-probs win where present (even conv_id, rounded to 2
#    places); the rest come from the reference table; data log-probs exist for conv_id % 3 = 0
#    and fall back to the reference
@register("attach_logps", f"""
WITH {TRAIN_PAIRS_SQL},
pre AS (SELECT conv_id, pair_idx, chosen_turn, rejected_turn,
               CASE WHEN conv_id % 2 = 0 THEN round(ref_chosen_logps, 2) END AS pre_c,
               CASE WHEN conv_id % 2 = 0 THEN round(ref_rejected_logps, 2) END AS pre_r FROM tp)
SELECT p.conv_id, p.pair_idx,
       {sql_r('coalesce(p.pre_c, rc.rho)')} AS ref_chosen_logps, {sql_r('coalesce(p.pre_r, rr.rho)')} AS ref_rejected_logps,
       {sql_r('coalesce(dc.dat, coalesce(p.pre_c, rc.rho))')} AS data_chosen_logps,
       {sql_r('coalesce(dr.dat, coalesce(p.pre_r, rr.rho))')} AS data_rejected_logps
FROM pre p
JOIN cand rc ON rc.conv_id = p.conv_id AND rc.turn = p.chosen_turn
JOIN cand rr ON rr.conv_id = p.conv_id AND rr.turn = p.rejected_turn
LEFT JOIN (SELECT conv_id, turn, dat FROM cand WHERE conv_id % 3 = 0) dc ON dc.conv_id = p.conv_id AND dc.turn = p.chosen_turn
LEFT JOIN (SELECT conv_id, turn, dat FROM cand WHERE conv_id % 3 = 0) dr ON dr.conv_id = p.conv_id AND dr.turn = p.rejected_turn
""")
def attach_logps(spark, sf):
    tp = train_pairs(spark, sf, models=("rho", "dat"))
    even, third = F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 == 0
    pre = tp.select("conv_id", "pair_idx", F.col("ref_chosen_logps").alias("rc"), F.col("ref_rejected_logps").alias("rr"),
                    F.when(third, F.col("data_chosen_logps")).alias("dc"), F.when(third, F.col("data_rejected_logps")).alias("dr"))
    pre = pre.withColumns({"ref_chosen_logps": F.when(even, F.round("rc", 2)), "ref_rejected_logps": F.when(even, F.round("rr", 2))})
    out = L.attach_logps(pre, ["conv_id", "pair_idx"], ref=("rc", "rr"), data=("dc", "dr"))
    return out.select("conv_id", "pair_idx", *[F.round(c_, 6).alias(c_) for c_ in
                                               ("ref_chosen_logps", "ref_rejected_logps",
                                                "data_chosen_logps", "data_rejected_logps")])
