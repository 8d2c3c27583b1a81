"""The online loop, labelling by implicit reward and feedback sets, and the remaining loader recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefengine.functions import text as T
from prefengine.functions.arrays import has_token, truncate_after
from prefengine.operators import metrics as MT
from prefengine.operators import order as O
from prefengine.operators import pairs as P
from prefengine.operators import text as X
from prefengine.operators import udf as U
from prefengine.operators.logprob import ngram_logps
from prefengine.operators.objectives import objective
from prefengine.operators.tokens import EOS, PAD, SPECIALS, token_list
from prefengine.plans.q_fit_udf import make_rotation_sampler
from prefengine.plans.q_logprob import _ASST, TRAIN_PAIRS_SQL, fit_models, pair_rows
from prefengine.plans.q_pairs import GEN_BUDGET, _PROMPTED
from prefengine.plans.q_text import _DIALOGUE_SQL, _dialogue
from prefengine.plans.registry import (register, sql_md5_bits, sql_ngram_model, sql_ngram_score, sql_r, sql_softplus,
                                       sql_text_score, table)
from prefengine.session import materialize, plan_bytes, shared_dir
from prefengine.sources import driver_tables as D
from prefengine.sources import readers as R
from prefengine.sources.sinks import write_json_arrays, write_jsonl

BETA = 0.1
SEED = 42
EOT = T.END_OF_TEXT


# -- R2 R3: label pairs by implicit reward beta (log p - log p_ref) of both sides instead of a judge
@register("implicit_labels", f"""
WITH {TRAIN_PAIRS_SQL},
r AS (SELECT conv_id, pair_idx, first_turn, second_turn, {sql_r(f'{BETA} * (pi_a - rho_a)')} AS a,
             {sql_r(f'{BETA} * (pi_b - rho_b)')} AS b FROM joined)
SELECT conv_id, pair_idx, CASE WHEN a > b THEN first_turn ELSE second_turn END AS chosen_turn,
       CASE WHEN a > b THEN second_turn ELSE first_turn END AS rejected_turn,
       greatest(a, b) AS chosen_score, least(a, b) AS rejected_score
FROM r
""")
def implicit_labels(spark, sf):
    pairs = pair_rows(spark, sf, models=("pi", "rho"))
    pairs = pairs.withColumns({f"reward_{s}": F.round(P.implicit_reward(f"pi_{s}", f"rho_{s}", BETA), 6) + 0.0 for s in ("a", "b")})
    lab = P.label_pairs(pairs, tie="second", unscored="raise", first="turn_a", second="turn_b",
                        first_score="reward_a", second_score="reward_b")
    return lab.select("conv_id", "pair_idx", F.col("chosen").alias("chosen_turn"), F.col("rejected").alias("rejected_turn"),
                      "chosen_score", "rejected_score")


# -- E2 R1 R3 K1: feedback sets: the first 16 pairs of (ctx, target) candidate sets, scored, ordered and
#    written as JSON Lines
FEEDBACK_K = 16
FEEDBACK_SCHEMA = "conv_id bigint, pair_idx bigint, prompt string, chosen string, rejected string, chosen_score double, rejected_score double"


@register("feedback_pairs", f"""
WITH {_PROMPTED},
sc AS (SELECT conv_id, turn, text, r, {sql_text_score('text')} AS s FROM ranked),
p AS (SELECT x.conv_id, q.prompt, x.text AS a, y.text AS b, x.s AS sa, y.s AS sb,
             row_number() OVER (PARTITION BY x.conv_id ORDER BY x.r, y.r) - 1 AS pair_idx
      FROM sc x JOIN sc y ON x.conv_id = y.conv_id AND x.r < y.r JOIN prompted q ON q.conv_id = x.conv_id)
SELECT conv_id, pair_idx, prompt, CASE WHEN sa > sb THEN a ELSE b END AS chosen, CASE WHEN sa > sb THEN b ELSE a END AS rejected,
       greatest(sa, sb) AS chosen_score, least(sa, sb) AS rejected_score
FROM p WHERE pair_idx < {FEEDBACK_K}
""")
def feedback_pairs(spark, sf):
    sets = D.candidate_sets(table(spark, sf, "conversations"), max_candidates=FEEDBACK_K + 1)
    sets = sets.select("conv_id", F.col("prompt").alias("ctx"), F.col("completion").alias("target"))
    pairs = P.candidate_pairs(sets, FEEDBACK_K, col="target", first="first", second="second")
    pairs = pairs.withColumns({f"{c}_score": D.text_score(c) for c in ("first", "second")})
    lab = P.label_pairs(pairs, tie="second", unscored="raise", first="first", second="second",
                        first_score="first_score", second_score="second_score")
    path = shared_dir(spark, "feedback")
    write_jsonl(lab.select("conv_id", "pair_idx", F.col("ctx").alias("prompt"), "chosen", "rejected", "chosen_score", "rejected_score"), path)
    return R.read_jsonl(spark, path, FEEDBACK_SCHEMA)


# -- S2: JSON-array files of a size that a task can write, written from the turns and scanned in pieces
ARRAY_BYTES = 256 << 20
TURN_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@register("json_array_scan", "SELECT conv_id, turn, role, text FROM conversations")
def json_array_scan(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    files = max(1, (plan_bytes(conv) or 0) // ARRAY_BYTES)
    path = shared_dir(spark, "arrays")
    write_json_arrays(conv.withColumn("_file", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(files))), path, "_file", files)
    return R.read_json_array(spark, path, TURN_SCHEMA)


# -- S1 with bad lines: turns written as JSON Lines, a quarter of them broken in four ways; the good ones come back typed, the
#    others are counted by what is wrong
@register("jsonl_quarantine", f"""
WITH b AS (SELECT *, {sql_md5_bits("conv_id::VARCHAR || ':' || turn::VARCHAR")} % 16 AS k FROM conversations)
SELECT 'ok' AS reason, conv_id, turn, role, text, 1::BIGINT AS lines FROM b WHERE k > 3
UNION ALL SELECT CASE k WHEN 0 THEN 'truncated' WHEN 1 THEN 'wrong type: conv_id, turn' WHEN 2 THEN 'not an object' ELSE 'syntax' END,
                 NULL, NULL, NULL, NULL, count(*) FROM b WHERE k <= 3 GROUP BY k
""")
def jsonl_quarantine(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    k = T.md5_bits("conv_id", "turn") % 16
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    typed = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("conv_id"), F.array("turn").alias("turn"), "role", "text"))
    line = (F.when(k == 0, F.substring(whole, 1, 24)).when(k == 1, typed).when(k == 2, F.to_json(F.array("conv_id", "turn")))
            .when(k == 3, F.concat(F.lit("conv_id: "), F.col("conv_id").cast("string"))).otherwise(whole))
    path = shared_dir(spark, "lines")
    conv.select(line.alias("value")).write.text(path)
    good, bad = R.read_jsonl_quarantine(spark, path, TURN_SCHEMA, max_bad=0.5)
    counts = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    return good.select(F.lit("ok").alias("reason"), "conv_id", "turn", "role", "text", F.lit(1).cast("bigint").alias("lines")).unionByName(counts, allowMissingColumns=True)


# -- S4: sources that name their splits by use, and a source whose test split is another source's
@register("split_sources", f"""
WITH {_DIALOGUE_SQL},
sft AS (SELECT u.conv_id, u.text AS prompt FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'),
c AS (SELECT DISTINCT conv_id, {sql_md5_bits('conv_id::VARCHAR')} % 4 = 0 AS held FROM conversations)
SELECT 'chat_prefs/test' AS request, conv_id, prompt FROM dlg JOIN c USING (conv_id) WHERE held
UNION ALL SELECT 'chat_sft/train', conv_id, prompt FROM sft JOIN c USING (conv_id) WHERE NOT held
UNION ALL SELECT 'sampled/train', conv_id, prompt FROM dlg JOIN c USING (conv_id) WHERE NOT held
UNION ALL SELECT 'sampled/test', conv_id, prompt FROM sft JOIN c USING (conv_id) WHERE held
""")
def split_sources(spark, sf):
    held = O.shard_of(4, "conv_id") == 0
    dlg = _dialogue(spark, sf).select("conv_id", "prompt")
    sft = D.sft_examples(table(spark, sf, "conversations")).select("conv_id", "prompt")
    roots = {n: shared_dir(spark, n) for n in ("prefs", "sft", "sampled")}
    for name, rows, test, train in (("prefs", dlg, "test_prefs", "train_prefs"), ("sft", sft, "test_sft", "train_sft")):
        rows.withColumn("split", F.when(held, test).otherwise(train)).write.partitionBy("split").parquet(roots[name])
    dlg.filter(~held).withColumn("split", F.lit("train")).write.partitionBy("split").parquet(roots["sampled"])
    sources = {"chat_prefs": R.Source(roots["prefs"], R.CHAT_PREFERENCE_SPLITS), "chat_sft": R.Source(roots["sft"], R.CHAT_SFT_SPLITS),
               "sampled": R.Source(roots["sampled"], elsewhere={"test": "chat_sft"})}
    out = None
    for name, split in (("chat_prefs", "test"), ("chat_sft", "train"), ("sampled", "train"), ("sampled", "test")):
        one = R.read_source(spark, sources, name, split).select(F.lit(f"{name}/{split}").alias("request"), "conv_id", "prompt")
        out = one if out is None else out.unionByName(one)
    return out


# -- P1 P2 P4: summarisation preferences: query becomes prompt, the end-of-text marker goes from both sides
@register("summary_prefs", f"""
WITH ranked AS (SELECT d.doc_id, d.lang, d.text, l.quality,
                       row_number() OVER (PARTITION BY d.lang, l.quality ORDER BY md5(d.doc_id::VARCHAR), d.doc_id) - 1 AS rk
                FROM documents d JOIN labels l USING (doc_id)),
nb AS (SELECT lang, count(*) AS n FROM ranked WHERE quality = 0 GROUP BY lang)
SELECT g.doc_id AS chosen_id, b.doc_id AS rejected_id, g.lang AS prompt, replace(g.text, '{EOT}', '') AS chosen, replace(b.text, '{EOT}', '') AS rejected
FROM ranked g JOIN nb ON nb.lang = g.lang JOIN ranked b ON b.lang = g.lang AND g.rk % nb.n = b.rk AND g.quality = 1 AND b.quality = 0
""")
def summary_prefs(spark, sf):
    raw = D.doc_pairs(table(spark, sf, "documents"), table(spark, sf, "labels")).withColumnRenamed("prompt", "query")
    raw = raw.withColumns({c: F.concat(c, F.lit(EOT)) for c in ("chosen", "rejected")})
    return X.strip_marker(X.canonical_pref(raw, "query", "chosen", "rejected", keep=["chosen_id", "rejected_id"]), ["chosen", "rejected"])


# -- P2 B1: helpful/harmless SFT: response becomes completion, shuffled
@register("dialogue_sft", f"""
WITH {_DIALOGUE_SQL}
SELECT conv_id, prompt, chosen AS completion,
       row_number() OVER (ORDER BY md5('{SEED}:' || conv_id::VARCHAR), conv_id) - 1 AS pos FROM dlg
""")
def dialogue_sft(spark, sf):
    raw = _dialogue(spark, sf).select("conv_id", "prompt", F.col("chosen").alias("response"))
    return O.shuffled_index(X.canonical_sft(raw, "prompt", "response", keep=["conv_id"]), SEED, "conv_id", name="pos")


# -- B4 U2 E1 T12 R4 R5 L6 J1 M1 M4: one pass of the online loop.  Every document is a prompt, sampled twice;
#    samples over the token budget lose their EOS and get score -1; the better one is chosen (the first
#    on ties), scored under policy and reference, and the DPO loss and metrics are averaged per interval
ONLINE_BATCH, ONLINE_ACCUM = 16, 4
_H = "((pi_c - pi_r) - (rho_c - rho_r))"
_GEN = """SELECT doc_id, k, array_to_string(list_slice(w, 1, {b}), ' ') AS text FROM g"""


@register("online_loop", f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, k, list_concat(list_slice(w, k + 1, len(w)), list_slice(w, 1, k)) AS w FROM d, range(0, 2) r(k)),
c AS (SELECT g.doc_id, g.k, len(w) <= {GEN_BUDGET} AS eos, t.text,
             CASE WHEN len(w) <= {GEN_BUDGET} THEN {sql_text_score('t.text')} ELSE -1.0 END AS s
      FROM g JOIN ({_GEN.format(b=GEN_BUDGET)}) t ON t.doc_id = g.doc_id AND t.k = g.k),
{sql_ngram_model('pol', _ASST)},
{sql_ngram_model('ref', 'SELECT text FROM documents')},
{sql_ngram_score('pi', 'pol', 'SELECT doc_id, k, text FROM c', ['doc_id', 'k'], out='pi')},
{sql_ngram_score('rho', 'ref', 'SELECT doc_id, k, text FROM c', ['doc_id', 'k'], out='rho')},
v AS (SELECT c.*, pi.pi, rho.rho FROM c JOIN pi ON pi.doc_id = c.doc_id AND pi.k = c.k JOIN rho ON rho.doc_id = c.doc_id AND rho.k = c.k),
lab AS (SELECT a.doc_id, greatest(a.s, b.s) - least(a.s, b.s) AS score_margin,
               CASE WHEN a.s >= b.s THEN a.pi ELSE b.pi END AS pi_c, CASE WHEN a.s >= b.s THEN b.pi ELSE a.pi END AS pi_r,
               CASE WHEN a.s >= b.s THEN a.rho ELSE b.rho END AS rho_c, CASE WHEN a.s >= b.s THEN b.rho ELSE a.rho END AS rho_r
        FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.k = 0 AND b.k = 1),
iv AS (SELECT *, (row_number() OVER (ORDER BY md5('{SEED}:' || doc_id::VARCHAR), doc_id) - 1) // {ONLINE_BATCH * ONLINE_ACCUM} AS interval FROM lab)
SELECT interval::BIGINT AS interval, count(*) AS examples, {sql_r(f"avg({sql_softplus(f'(-{BETA} * {_H})')})")} AS loss,
       {sql_r(f'avg({BETA} * (pi_c - rho_c) - {BETA} * (pi_r - rho_r))', 4)} AS margins,
       {sql_r('avg(score_margin)')} AS score_margin, {sql_r('avg(((pi_c - rho_c) + (pi_r - rho_r)) / 2.0)', 4)} AS kl
FROM iv GROUP BY interval
""")
def online_loop(spark, sf):
    models = fit_models(spark, sf, ("pi", "rho"))  # its shuffle files are gone before the samples are written
    prompts = table(spark, sf, "documents").select("doc_id", F.array_join(token_list("text"), " ").alias("prompt"))
    gen = U.generate_with(prompts, make_rotation_sampler, "prompt", 2)
    samples = P.flatten_candidates(gen.select("doc_id", T.rstrip_all("completion").alias("completion")))
    eos, pad = SPECIALS[EOS], SPECIALS[PAD]
    t = samples.withColumn("_t", token_list("completion"))
    t = t.withColumn("gen", F.when(F.size("_t") <= GEN_BUDGET, F.array_append("_t", F.lit(eos))).otherwise(F.slice("_t", 1, GEN_BUDGET)))
    words = F.filter(truncate_after("gen", eos, pad), lambda x: ~x.isin(eos, pad))
    t = t.select("doc_id", "cand_idx", F.array_join(words, " ").alias("text"), has_token("gen", eos).alias("has_eos"))
    t = t.withColumn("score", P.penalise_unterminated(D.text_score("text"), "has_eos"))
    # sampled once, read by every join below; two samples of a document are alike, which only a codec with a long window sees
    t = materialize(t.select("doc_id", "cand_idx", "text", "score"), "samples", codec="zstd")
    key = ["doc_id", "cand_idx"]
    lp = ngram_logps(t.select(*key, "text"), key, "text", models)
    two = P.pair_samples(t.select(*key, "score").join(lp, key), ["doc_id"], "cand_idx", ["cand_idx", "score", "pi", "rho"])
    lab = P.label_pairs(two, tie="first", unscored="raise", first="cand_idx_0", second="cand_idx_1", first_score="score_0",
                        second_score="score_1", carry={"logps": ("pi_0", "pi_1"), "ref": ("rho_0", "rho_1")})
    lab = lab.withColumnRenamed("chosen_ref", "ref_chosen_logps").withColumnRenamed("rejected_ref", "ref_rejected_logps")
    m = MT.pair_metrics(objective(lab, "dpo", beta=BETA), BETA).withColumn("_k", O.shuffle_key(SEED, "doc_id"))
    out = MT.interval_means(m.select("doc_id", "_k", "loss", "margins", "score_margin", "kl"), ["loss", "margins", "score_margin", "kl"],
                            ONLINE_BATCH, ONLINE_ACCUM, ["_k", "doc_id"])
    return out.select("interval", "examples", F.round("loss", 6).alias("loss"), F.round("margins", 4).alias("margins"),
                      F.round("score_margin", 6).alias("score_margin"), F.round("kl", 4).alias("kl"))
